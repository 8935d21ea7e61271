"""Exact quartiles per group without gathering a group in one task.

Values are counted in narrow logarithmic bins (map-side combined), the bins give the position of
every rank, and only the few bins whose value at a wanted rank is still unknown are looked at again.
Groups with NULL keys are groups like others; infinite values are the outermost, and NaN is no value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.staging import attach, stage_measured

BINS_PER_E = 4096  # a bin spans 0.024 % of its value
_INFINITE = 2**31 - 1
# Positive values have bins within 2**22 of zero.
_ZERO, _NEGATIVE = -(2**23), -(2**24)
_PROBABILITIES = {"q1": 0.25, "q3": 0.75}


def bin_of(value: Column) -> Column:
    """Order-preserving bin of a number; zero and the infinities have bins of their own, below zero the bins fall."""
    bin = F.floor(F.ln(F.abs(value)) * BINS_PER_E).try_cast("int")
    return (
        F.when(value == float("inf"), _INFINITE).when(value == float("-inf"), -_INFINITE)
        .when(value > 0, bin).when(value < 0, F.lit(_NEGATIVE) - bin).when(value == 0, _ZERO)
    )


def _wanted_ranks(total: Column) -> dict[str, Column]:
    """The 0-based ranks on both sides of each quartile."""
    ranks = {}
    for name, p in _PROBABILITIES.items():
        position = (total - 1) * p
        ranks[f"{name}_low"], ranks[f"{name}_high"] = F.floor(position), F.ceil(position)
    return ranks


def quartiles(df: DataFrame, keys: Sequence[str], value: str = "amount", positive: bool = True) -> DataFrame:
    """``q1``, ``q3`` (linear interpolation), ``total`` rows and ``top`` value per group.

    Only positive values count, or all numbers if ``positive`` is false; other rows are ignored.
    """
    v = F.col(value)
    values = df.filter((v > 0 if positive else v.isNotNull()) & ~F.isnan(v)).select(*keys, bin_of(v).alias("bin"), v.alias("v"), F.lit(1).cast("long").alias("n"))
    return quartiles_of_bins(bins_of(values, keys), values, keys)


def bins_of(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, least and largest value per bin; bins of parts of the rows can be united. ``values`` has ``bin``, ``v``, ``n``."""
    return values.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def quartiles_of_bins(bins: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``quartiles`` out of ``bins_of``; ``values`` are read in the few bins where counts do not tell."""
    keys = list(keys)
    ranked = _by_bins(bins, values, keys)
    for q, p in _PROBABILITIES.items():
        ranked = ranked.withColumn(q, _between(F.col(f"{q}_low"), F.col(f"{q}_high"), (F.col("total") - 1) * p))
    return ranked.select(*keys, "total", "top", "q1", "q3")


def _by_bins(bins: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Values at the wanted ranks by counting bins; no task sees more than a group's bins or one bin's values."""
    # Windows run over bins, of which a group has some ten thousand, not over rows.
    whole = Window.partitionBy(*keys)
    up_to = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        bins.withColumn("before", F.sum("n").over(up_to) - F.col("n"))
        .withColumn("total", F.sum("n").over(whole))
        .withColumn("top", F.max("high").over(whole))
    )
    offsets = {name: rank - F.col("before") for name, rank in _wanted_ranks(F.col("total")).items()}
    held = {name: (offset >= 0) & (offset < F.col("n")) for name, offset in offsets.items()}
    known = {
        name: F.when((F.col("low") == F.col("high")) | (offset == 0), F.col("low")).when(offset == F.col("n") - 1, F.col("high"))
        for name, offset in offsets.items()
    }
    # One row per group; the bins whose values must be read are few, and listed in it.
    at = {name: F.max(F.when(held[name], known[name])) for name in offsets}
    open_at = {name: held[name] & known[name].isNull() for name in offsets}
    groups = placed.groupBy(*keys).agg(
        F.max("total").alias("total"), F.max("top").alias("top"), *[c.alias(n) for n, c in at.items()],
        *[F.max(F.when(o, F.col("bin"))).alias(f"_{n}_bin") for n, o in open_at.items()],
        *[F.max(F.when(o, offsets[n])).alias(f"_{n}_offset") for n, o in open_at.items()],
    )
    entries = [
        F.when(F.col(f"_{n}_bin").isNotNull(), F.struct(F.lit(n).alias("name"), F.col(f"_{n}_bin").alias("bin"), F.col(f"_{n}_offset").alias("offset")))
        for n in offsets
    ]
    groups = groups.select(*keys, "total", "top", *offsets, F.array_compact(F.array(*entries)).alias("open"))
    groups, size = stage_measured(groups, "ranks", F.size("open") > 0)
    if not size:
        return groups.drop("open")
    open_ranks = groups.select(*keys, F.explode("open").alias("open")).select(*keys, "open.*")
    found = _values_at(values, open_ranks, keys, size).groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(f"_{name}") for name in offsets]
    )
    joined = attach(groups.drop("open"), found, keys, "left", size=size, null_safe=True)
    return joined.select(*keys, "total", "top", *[F.coalesce(name, f"_{name}").alias(name) for name in offsets])


def _between(low: Column, high: Column, position: Column) -> Column:
    """Linear interpolation, counted from the nearer end; equal ends are the value itself."""
    part = position - F.floor(position)
    return F.when(low == high, low).when(part < 0.5, low + (high - low) * part).otherwise(high - (high - low) * (1 - part))


def _values_at(binned: DataFrame, open_ranks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Exact values for ranks that fall strictly inside a bin of differing values."""
    # The keys as one text, which is never NULL, so that NULL keys meet.
    group = F.to_json(F.struct(*keys)).alias("group")
    at_bin = ["group", "bin"]
    wanted = open_ranks.select(group, "bin", "name", "offset", *keys)
    # Equal values are counted before the join, so copies of one value cannot pile up in a task.
    # A broadcast semi join is pushed below the count by Spark, so then only open bins are counted.
    counted = binned.groupBy(group, "bin", "v").agg(F.sum("n").alias("n"))
    values = attach(counted, wanted.select(*at_bin).distinct(), at_bin, "left_semi", size=size)
    up_to = Window.partitionBy(*at_bin).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.withColumn("before", F.sum("n").over(up_to) - F.col("n"))
    hit = (F.col("offset") >= F.col("before")) & (F.col("offset") < F.col("before") + F.col("n"))
    return placed.join(wanted, at_bin).filter(hit).select(*keys, "name", "v")
