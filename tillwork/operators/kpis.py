"""Key figures per client."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.text import hour_band, is_service, round_even, whole

CLIENT = ["client_id"]
TOP_N = 5

OK = "ok"
NO_VALID_ROWS = "no_valid_rows"
NO_VALID_DATES = "no_valid_dates"
EMPTY_PERIOD = "empty_period"
NO_ITEM_COLUMN = "no_item_column"


def exact_sum(c: Column | str) -> Column:
    """Sum that does not depend on row order, as double.

    Values that no decimal(28,6) holds cannot stop a job: their group is summed as doubles instead.
    """
    value = F.col(c) if isinstance(c, str) else c
    money = value.try_cast("decimal(28,6)")
    exact = F.try_sum(money).cast("double")
    return F.when(F.count(money) == F.count(value), F.coalesce(exact, F.sum(value.cast("double")))).otherwise(F.sum(value.cast("double")))


def rows_where(df: DataFrame, condition: Column | None = None) -> Column:
    """Number of rows; in a rollup, of the rows that its rows stand for (its column ``rows``)."""
    if "rows" not in df.columns:
        return F.count("*" if condition is None else F.when(condition, 1))
    return F.coalesce(F.sum("rows" if condition is None else F.when(condition, F.col("rows"))), F.lit(0).cast("long"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which some may be NULL: NULL meets NULL."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def ratio(total: Column, count: Column) -> Column:
    return F.coalesce(F.try_divide(total, count.cast("double")), F.lit(0.0))


def by_day(sales: DataFrame, keys: Sequence[str] = CLIENT) -> DataFrame:
    """Revenue and rows per day."""
    return sales.groupBy(*keys, F.to_date("sale_ts").alias("day")).agg(
        exact_sum("amount").alias("revenue"), rows_where(sales).alias("rows")
    )


def best_day(days: DataFrame, keys: Sequence[str] = CLIENT) -> DataFrame:
    """Day with the highest revenue; the earliest of equals. ``days`` comes from ``by_day``."""
    return days.groupBy(*keys).agg(_best_day())


def _best_day() -> Column:
    return F.max_by("day", F.struct("revenue", -F.unix_date("day"))).alias("best_day")


def transactions(sales: DataFrame, keys: Sequence[str] = CLIENT) -> DataFrame:
    """Distinct order references where the source has them, else rows.

    Spark groups by key and reference first, so one huge client is spread over its references.
    """
    return sales.groupBy(*keys).agg(_transactions(sales))


def _transactions(sales: DataFrame) -> Column:
    has_order = F.coalesce("has_order", F.lit(False))
    refs = F.count_distinct(F.when(has_order, F.col("order_ref")))
    return (refs + rows_where(sales, ~has_order)).alias("transactions")


def totals(sales: DataFrame, keys: Sequence[str] = CLIENT) -> DataFrame:
    """Revenue and transactions in one aggregate."""
    return sales.groupBy(*keys).agg(exact_sum("amount").alias("total"), _transactions(sales))


def revenue(sales: DataFrame, keys: Sequence[str] = CLIENT) -> DataFrame:
    return sales.groupBy(*keys).agg(exact_sum("amount").alias("total"))


def peak_hour(sales: DataFrame, keys: Sequence[str] = CLIENT) -> DataFrame:
    """Busiest hour as ``14h-15h``, earliest of equals; NULL if all rows share one hour."""
    hours = sales.filter("sale_ts is not null").groupBy(*keys, F.hour("sale_ts").alias("hour")).agg(rows_where(sales).alias("n"))
    return _peak_of_hours(hours, keys)


def _peak_of_hours(hours: DataFrame, keys: Sequence[str]) -> DataFrame:
    top = F.max_by("hour", F.struct("n", -F.col("hour")))
    return hours.groupBy(*keys).agg(F.when(F.count("*") > 1, hour_band(top)).alias("peak_hour"))


def vs_yesterday(sales: DataFrame, as_of: dt.date, keys: Sequence[str] = CLIENT) -> DataFrame:
    """Revenue change against the day before in percent, one decimal; NULL without both days."""
    return _change(by_day(sales, keys), as_of, keys)


def _change(days: DataFrame, as_of: dt.date, keys: Sequence[str]) -> DataFrame:
    today = F.sum(F.when(F.col("day") == F.lit(as_of), F.col("revenue")))
    yesterday = F.sum(F.when(F.col("day") == F.lit(as_of - dt.timedelta(days=1)), F.col("revenue")))
    change = F.try_divide(today - yesterday, yesterday) * 100
    return days.groupBy(*keys).agg(round_even(change, 1).alias("vs_yesterday_pct"))


def daily_change(days: DataFrame, keys: Sequence[str] = CLIENT) -> DataFrame:
    """Change against the calendar day before, for every day. Gaps give NULL, which ``lag`` would not.

    The frame is the one day before by its number; a client has one row a day, so the calendar bounds a window.
    """
    day_before = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(-1, -1)
    before = F.when(F.col("day").isNotNull(), F.max("revenue").over(day_before))
    dated = days.withColumn("revenue_before", before)
    change = F.try_divide(F.col("revenue") - F.col("revenue_before"), F.col("revenue_before")) * 100
    return dated.withColumn("change_pct", round_even(change, 1))


def order_sketches(sales: DataFrame, keys: Sequence[str] = CLIENT, precision: int = 12) -> DataFrame:
    """Per day a sketch of the distinct order references, and the rows that have none: a few KB however many orders.

    Days can be kept and united later, for any period, without the sales; the exact count cannot.
    """
    has_order = F.coalesce("has_order", F.lit(False))
    refs = F.when(has_order, F.col("order_ref").cast("string"))
    return sales.groupBy(*keys, F.to_date("sale_ts").alias("day")).agg(
        F.hll_sketch_agg(refs, F.lit(precision)).alias("orders"), rows_where(sales, ~has_order).alias("plain")
    )


def about_transactions(sketches: DataFrame, keys: Sequence[str] = CLIENT) -> DataFrame:
    """Transactions out of ``order_sketches``; with the usual precision mostly within 2 % of ``transactions``."""
    united = F.hll_sketch_estimate(F.hll_union_agg("orders"))
    return sketches.groupBy(*keys).agg((united + F.sum("plain")).alias("transactions"))


def item_totals(sales: DataFrame, keys: Sequence[str] = CLIENT) -> DataFrame:
    """Quantity, revenue and rows per item, with the value that ranks items.

    Volume ranks items; services without quantities rank by revenue, since one large project
    matters more than several small ones.
    """
    totals = sales.filter(F.coalesce("has_item", F.lit(False)) & F.col("item").isNotNull()).groupBy(*keys, "item").agg(
        exact_sum("quantity").alias("quantity"),
        exact_sum("amount").alias("amount"),
        F.max(is_service(F.col("business_type")) & ~F.coalesce("has_qty", F.lit(False))).alias("by_revenue"),
    )
    return totals.withColumn("weight", F.when(F.col("by_revenue"), F.col("amount")).otherwise(F.col("quantity")))


def top_items(sales: DataFrame, n: int = TOP_N, keys: Sequence[str] = CLIENT) -> DataFrame:
    """The ``n`` leading items per client with rank, whole quantity (a double, so of any size) and revenue.

    Items are summed before they are ranked, and Spark cuts each task to its own ``n`` rows per
    client before the shuffle, so the window never sees a client's full item list.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), F.asc("item"))
    ranked = item_totals(sales, keys).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select(*keys, "rank", "item", whole(F.col("quantity")).alias("quantity"), "amount")


def item_of_day(sales: DataFrame, keys: Sequence[str] = CLIENT) -> DataFrame:
    """The leading item with its quantity and revenue, out of the same aggregate as the ranking."""
    return top_items(sales, 1, keys).drop("rank")


def with_shares(top: DataFrame, keys: Sequence[str] = CLIENT) -> DataFrame:
    """Share of the listed volume and ratio to the leading item; five rows per client."""
    whole = Window.partitionBy(*keys)
    total = F.sum(F.col("quantity").cast("double")).over(whole)
    share = F.coalesce(F.try_divide(F.col("quantity").cast("double"), total), F.lit(0.0)) * 100
    ratio_to_max = F.coalesce(
        F.try_divide(F.col("quantity").cast("double"), F.max("quantity").over(whole).cast("double")), F.lit(0.0)
    )
    return top.withColumns({"share_pct": share, "ratio_to_max": ratio_to_max})


def _main_figures(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Revenue, best day and transactions in one pass, so that costly ``sales`` are computed once.

    Rows are grouped by day and by order reference as two grouping sets, combined before the one
    shuffle; a client's days and references are then summed. No client's rows meet in one task.
    """
    has_order = F.coalesce("has_order", F.lit(False))
    rows = sales.select(
        *keys, F.to_date("sale_ts").alias("day"), F.when(has_order, F.col("order_ref")).alias("_ref"),
        "amount", has_order.alias("_has_ref"), *[c for c in ("rows",) if c in sales.columns],
    )
    sets = rows.groupingSets([[*keys, "day"], [*keys, "_ref"]], *keys, "day", "_ref").agg(
        F.grouping("_ref").alias("_by_day"), exact_sum("amount").alias("revenue"), rows_where(rows, ~F.col("_has_ref")).alias("_plain")
    )
    of_day = F.col("_by_day") == 1
    refs = F.count(F.when(~of_day, F.col("_ref")))
    return sets.groupBy(*keys).agg(
        exact_sum(F.when(of_day, F.col("revenue"))).alias("total"),
        F.max_by("day", F.when(of_day, F.struct("revenue", -F.unix_date("day")))).alias("best_day"),
        (refs + F.sum(F.when(of_day, F.col("_plain")))).alias("transactions"),
    )


def kpis(
    sales: DataFrame,
    as_of: dt.date | None = None,
    keys: Sequence[str] = CLIENT,
    daily: bool = False,
    comparison: DataFrame | None = None,
) -> DataFrame:
    """Key figures per client over the given rows; ``as_of`` is needed for daily figures and the month's name.

    ``daily`` adds peak hour, change against yesterday and item of the day; ``comparison`` holds
    the rows of both days where ``sales`` holds only today's. The daily figures are narrow
    aggregates of their own, so ``sales`` should then be a stored table when it is costly to compute.
    """
    keys = list(keys)
    result = _main_figures(sales, keys).withColumn("avg_ticket", ratio(F.col("total"), F.col("transactions")))
    if daily:
        item = item_of_day(sales, keys).select(*keys, F.struct("item", "quantity", "amount").alias("item_of_day"))
        change = _change(by_day(sales if comparison is None else comparison, keys), as_of, keys)
        for part in (peak_hour(sales, keys), change, item):
            result = null_safe_join(result, part, keys, "left")
    else:
        result = result.withColumns({
            "peak_hour": F.lit(None).cast("string"),
            "vs_yesterday_pct": F.lit(None).cast("double"),
            "item_of_day": F.lit(None).cast("struct<item:string,quantity:double,amount:double>"),
        })
    return result.withColumns({
        "month_name": F.date_format(F.lit(as_of).cast("date"), "MMMM"),
        "change_pct": F.lit(None).cast("double"),
    })


def source_facts(classified: DataFrame, in_period: Column, keys: Sequence[str] = CLIENT) -> DataFrame:
    """Row counts per client that explain an empty result. ``classified`` comes from ``classify``."""
    good = F.col("reason").isNull()
    past_row_checks = good | (F.col("reason") == "bad_date")
    return classified.groupBy(*keys).agg(
        rows_where(classified, past_row_checks).alias("rows_valid"),
        rows_where(classified, good).alias("rows_dated"),
        rows_where(classified, good & ~in_period).alias("rows_outside_period"),
        F.coalesce(F.max(F.when(good, F.col("has_item"))), F.lit(False)).alias("has_item"),
    )


def complete(kpi_rows: DataFrame, facts: DataFrame, clients: DataFrame, as_of: dt.date, keys: Sequence[str] = CLIENT) -> DataFrame:
    """One row for every client: zeros, the run day and a status where there is nothing to report.

    ``clients`` has the keys and ``business_type``.
    """
    joined = clients.join(facts, list(keys), "left").join(kpi_rows, list(keys), "left")
    counted = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    status = (
        F.when(counted("rows_valid") == 0, NO_VALID_ROWS)
        .when(counted("rows_dated") == 0, NO_VALID_DATES)
        .when(F.col("total").isNull(), EMPTY_PERIOD)
        .when(~F.coalesce("has_item", F.lit(False)), NO_ITEM_COLUMN)
        .otherwise(OK)
    )
    return joined.select(
        *keys,
        F.coalesce("total", F.lit(0.0)).alias("total"),
        counted("transactions").alias("transactions"),
        F.coalesce("avg_ticket", F.lit(0.0)).alias("avg_ticket"),
        F.coalesce("best_day", F.lit(as_of)).alias("best_day"),
        F.date_format(F.lit(as_of), "MMMM").alias("month_name"),
        F.lit(None).cast("double").alias("change_pct"),
        "peak_hour", "vs_yesterday_pct", "item_of_day",
        F.lower(F.coalesce(F.nullif("business_type", F.lit("")), F.lit("retalho"))).alias("business_type"),
        counted("rows_outside_period").alias("rows_outside_period"),
        status.alias("status"),
    )
