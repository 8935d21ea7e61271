"""Places of rows in an order, without a window over a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.staging import attach, stage


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], place: str = "place", size: str = "size") -> DataFrame:
    """Adds each row's place (from 0) in its group by ``order``, NULLs first, and the rows of its group.

    Rows are dealt by ranges of (group, order), so a large group lies in many tasks, and only the rows of
    each group in each range are counted over: a running window over as many rows as there are ranges.
    Rows that are equal in all of these columns get places in any order, the same in every run of a task
    because the rows are written before they are dealt. ``df`` must not have columns beginning with ``_``.
    """
    written = stage(df.withColumn("_copy", F.monotonically_increasing_id()), "unordered")
    keys = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    dealt = written.repartitionByRange(*keys, F.col("_copy").asc()).sortWithinPartitions(*keys, F.col("_copy").asc())
    ordered = stage(dealt.drop("_copy").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    # A NULL group is a group: the join below needs a key that equals itself.
    key: Column = F.struct(*groups) if groups else F.lit(0)
    named = F.to_json(key, {"ignoreNullFields": "false"}) if groups else key.cast("string")
    counts = ordered.groupBy(named.alias("_group"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    here = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(here.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.select("_group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(here).alias(size))
    joined = attach(ordered.withColumns({"_group": named, "_part": part}), ranges, ["_group", "_part"], "inner")
    return joined.withColumn(place, F.col("_at") + F.col("_shift")).drop("_group", "_part", "_shift", "_at")
