"""All registered queries; importing the query modules registers them."""

from tillwork.plans import cleaning_queries, client_queries, figure_queries, message_queries, source_queries, store_queries  # noqa: F401
from tillwork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
