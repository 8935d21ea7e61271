"""The client table: scan with defaults, lookup by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.text import normalise_phone
from tillwork.vocabulary import DEFAULT_BUSINESS_TYPE, DEFAULT_CADENCE


def _default(name: str, value: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value))


def with_defaults(clients: DataFrame) -> DataFrame:
    """Fill business type and cadence; ``history`` text becomes an array."""
    history = F.coalesce(F.from_json(F.nullif("history", F.lit("")), "array<string>"), F.array().cast("array<string>"))
    return clients.withColumns({
        "business_type": _default("business_type", DEFAULT_BUSINESS_TYPE),
        "cadence": _default("cadence", DEFAULT_CADENCE),
        "history": history,
    })


def lookup(clients: DataFrame, phone: str) -> DataFrame:
    """One client by phone number, in any of its spellings; the filter reaches the scan."""
    return with_defaults(clients.filter(F.col("client_id") == normalise_phone(F.lit(phone))))


def lookup_many(clients: DataFrame, phones: DataFrame) -> DataFrame:
    """Clients for a table with a ``phone`` column; unknown numbers keep NULL columns."""
    wanted = phones.withColumn("client_id", normalise_phone(F.col("phone")))
    return wanted.join(with_defaults(clients), "client_id", "left")
