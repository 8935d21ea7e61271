"""Mergeable partial sums of cleaned sales, kept per source, from which all key figures are read."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.operators import silver
from tillwork.operators.kpis import exact_sum
from tillwork.plans.reporting import figures_of
from tillwork.sources import buckets
from tillwork.sources.buckets import BucketTable
from tillwork.sources.commits import CommitLog
from tillwork.staging import stage

# A row of the rollup: sums over a source's sales of one hour, item and order.
KEYS = ["client_id", "source_id", "business_type", "sale_ts", "item", "order_ref", "has_item", "has_qty", "has_order", "reason"]


def rolled_up(classified: DataFrame) -> DataFrame:
    """Sums by client, source, hour, item and order reference, with the number of sales behind them.

    Rows that only lack a date are counted too, since they explain an empty result; other rejects are not.
    A rollup has the columns of sales that figures read, and ``rows``, so it can be rolled up again.
    """
    hour = F.date_trunc("hour", "sale_ts").cast("timestamp_ntz")
    kept = classified.filter("reason is null or reason = 'bad_date'").withColumn("sale_ts", hour)
    return kept.groupBy(*KEYS).agg(exact_sum("amount").alias("amount"), exact_sum("quantity").alias("quantity"), F.count("*").alias("rows"))


class Rollup:
    """The rollup of all sources as a bucketed table under a commit log.

    An upload is cleaned by itself (its fence and checks concern no other source) and replaces the rows of
    its source; only the buckets of its clients are read and written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)

    def rows(self, clients: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the buckets that hold ``clients`` (``client_id``)."""
        _, entry = self.log.latest()
        table = BucketTable(**entry["rollup"])
        return table.read(self.spark, None if clients is None else table.touched(clients))

    def replace(
        self, sales: DataFrame, run_day: dt.date, count: int = 64, checks: Callable[[DataFrame], DataFrame] = silver.classify
    ) -> int:
        """Clean the sales of some sources by ``checks`` and put their sums in place of what there was of those sources."""
        version, entry = self.log.latest()
        new = rolled_up(silver.fill_fallbacks(checks(sales), run_day))
        if version < 0:
            table = buckets.create(new, self.path, "client_id", count)
        else:
            # A source whose rows were all rejected goes too.
            sources = stage(sales.select("client_id", "source_id").distinct(), "replaced")
            table = BucketTable(**entry["rollup"])
            table = table.merged(sources, lambda old, gone: old.join(gone, ["client_id", "source_id"], "left_anti").unionByName(new))
        return self.log.commit({"rollup": table.entry()}, version)

    def figures(
        self, clients: DataFrame, as_of: dt.date, period: str | None = None, daily: bool = False
    ) -> tuple[DataFrame, DataFrame]:
        """(one row per client, ranked items), like ``key_figures`` over the sales behind the rollup."""
        return figures_of(self.rows(), clients, as_of, period, daily)
