"""Reporting periods as half-open day ranges, so that they reach a parquet scan as range filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.operators.silver import DATASET
from tillwork.staging import attach

TODAY, WEEK, MONTH = "hoje", "semana", "mes"


def period_range(period: str, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """First day and day after the last."""
    if period == TODAY:
        return as_of, as_of + dt.timedelta(days=1)
    if period == WEEK:
        return as_of - dt.timedelta(days=as_of.weekday()), as_of + dt.timedelta(days=1)
    if period == MONTH:
        first = as_of.replace(day=1)
        return first, (first + dt.timedelta(days=32)).replace(day=1)
    raise ValueError(f"unknown period: {period}")


def between(ts: str, first: dt.date, end: dt.date) -> Column:
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    return (F.col(ts) >= at(first)) & (F.col(ts) < at(end))


def today_and_yesterday(sales: DataFrame, as_of: dt.date, ts: str = "sale_ts") -> DataFrame:
    return sales.filter(between(ts, as_of - dt.timedelta(days=1), as_of + dt.timedelta(days=1)))


def latest_years(sales: DataFrame, keys: Sequence[str] = DATASET, ts: str = "sale_ts") -> DataFrame:
    return sales.groupBy(*keys).agg(F.max(F.year(ts)).alias("latest_year"), F.min(F.year(ts)).alias("first_year"))


def in_latest_year(sales: DataFrame, keys: Sequence[str] = DATASET, ts: str = "sale_ts") -> DataFrame:
    """Adds ``in_period``: whether the row lies in the latest year of its dataset.

    Datasets that span a single year need no lookup and are left out of the joined table.
    """
    several = latest_years(sales, keys, ts).filter("latest_year > first_year").drop("first_year")
    joined = attach(sales, several, list(keys), "left", null_safe=True)
    return joined.withColumn("in_period", F.coalesce(F.year(ts) == F.col("latest_year"), F.lit(True))).drop("latest_year")


def filter_period(
    sales: DataFrame, period: str | None, as_of: dt.date, keys: Sequence[str] = DATASET, ts: str = "sale_ts"
) -> DataFrame:
    """Rows of the period; without a period, those of each dataset's latest year."""
    if period is None:
        return in_latest_year(sales, keys, ts).filter("in_period").drop("in_period")
    return sales.filter(between(ts, *period_range(period, as_of)))
