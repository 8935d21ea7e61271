"""Cleaning: derived columns, row checks, the outlier fence. Rejected rows keep a reason."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.operators.quantiles import quartiles
from tillwork.staging import attach, stage

DATASET = ["client_id", "source_id"]


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def has_amount() -> Column:
    """The source gives a total, or price and quantity to derive it from."""
    return _flag("has_total") | (_flag("has_qty") & _flag("has_price"))


def derive_total(sales: DataFrame) -> DataFrame:
    """Total from price and quantity (missing counts as 0) where the source has no total column."""
    zero = F.lit(0.0)
    product = F.coalesce("unit_price", zero) * F.coalesce("quantity", zero)
    amount = (
        F.when(_flag("has_total"), F.col("amount"))
        .when(_flag("has_qty") & _flag("has_price"), product)
        .otherwise(zero)
    )
    return sales.withColumn("amount", amount)


def fill_fallbacks(sales: DataFrame, run_day: dt.date | Column) -> DataFrame:
    """Run day for sources without dates, quantity 1 for sources without quantities."""
    day = run_day if isinstance(run_day, Column) else F.lit(run_day)
    return sales.withColumns({
        "sale_ts": F.when(_flag("has_date"), F.col("sale_ts")).otherwise(day.cast("timestamp_ntz")),
        "quantity": F.when(_flag("has_qty"), F.col("quantity")).otherwise(F.lit(1.0)),
    })


def price_mismatch(tolerance: float = 0.10) -> Column:
    """Total differs from quantity times price by more than the tolerance; only where both are positive."""
    zero = F.lit(0.0)
    quantity, price = F.coalesce("quantity", zero), F.coalesce("unit_price", zero)
    expected = quantity * price
    off = F.abs(F.col("amount") - expected) > expected * tolerance
    return _flag("has_qty") & _flag("has_price") & (quantity > 0) & (price > 0) & off


def cross_check(sales: DataFrame, tol: float = 0.10) -> DataFrame:
    """Rows whose total agrees with quantity times price."""
    return sales.filter(~F.coalesce(price_mismatch(tol), F.lit(False)))


def row_reason(tol: float = 0.10) -> Column:
    """First failed row check, in the order the checks apply; NULL for a good row."""
    order_cell = F.lower(F.col("order_ref"))
    repeated_header = _flag("has_order") & order_cell.eqNullSafe(F.lower("order_name")) & F.col("order_ref").isNotNull()
    amount_ok = F.coalesce(F.col("amount") > 0, F.lit(False)) & ~F.isnan("amount")
    quantity_ok = F.coalesce(F.col("quantity") > 0, F.lit(False)) & ~F.coalesce(F.isnan("quantity"), F.lit(False))
    return (
        F.when(_flag("is_blank"), "blank_row")
        .when(repeated_header, "repeated_header")
        .when(has_amount() & ~amount_ok, "bad_total")
        .when(_flag("has_qty") & ~quantity_ok, "bad_quantity")
        .when(_flag("has_item") & has_amount() & F.col("item").isNull(), "missing_item")
        .when(price_mismatch(tol), "price_mismatch")
    )


def fence_limits(sales: DataFrame, keys: Sequence[str] = DATASET, k: float = 3.0, min_rows: int = 4) -> DataFrame:
    """Upper limit per dataset, only for datasets that have an amount above it; zero and negative amounts count too."""
    return limits_of(quartiles(sales, keys, positive=False), keys, k, min_rows)


def limits_of(found: DataFrame, keys: Sequence[str] = DATASET, k: float = 3.0, min_rows: int = 4) -> DataFrame:
    """``fence_limits`` out of quartiles."""
    spread = F.col("q3") - F.col("q1")
    limits = found.withColumn("fence", F.col("q3") + k * spread)
    return limits.filter((F.col("total") >= min_rows) & (spread > 0) & (F.col("top") > F.col("fence"))).select(*keys, "fence")


def mark_outliers(sales: DataFrame, limits: DataFrame, keys: Sequence[str] = DATASET) -> DataFrame:
    """Adds ``is_outlier``; datasets without a limit have none."""
    joined = attach(sales, limits, list(keys), "left", null_safe=True)
    return joined.withColumn("is_outlier", F.coalesce(F.col("amount") > F.col("fence"), F.lit(False))).drop("fence")


def iqr_fence(sales: DataFrame, k: float = 3.0, min_rows: int = 4, keys: Sequence[str] = DATASET) -> DataFrame:
    """Rows at or below the third quartile plus ``k`` times the quartile distance of their dataset."""
    limits = fence_limits(sales, keys, k, min_rows)
    return mark_outliers(sales, limits, keys).filter("not is_outlier").drop("is_outlier")


def classify(sales: DataFrame, tol: float = 0.10, k: float = 3.0, min_rows: int = 4) -> DataFrame:
    """All rows with ``reason``: NULL for valid rows, else why the row was set aside.

    The fence sees only rows that passed the row checks, and comes before the date check. The
    checked rows are staged once, because both the fence and the result read them.
    """
    checked = derive_total(sales).withColumn("reason", row_reason(tol))
    checked = stage(checked, "checked")
    fenced = checked.filter("reason is null").filter(has_amount())
    marked = mark_outliers(checked, fence_limits(fenced, DATASET, k, min_rows))
    late = F.when(F.col("is_outlier") & has_amount(), "outlier").when(
        _flag("has_date") & F.col("sale_ts").isNull(), "bad_date"
    )
    return marked.withColumn("reason", F.coalesce("reason", late)).drop("is_outlier")


def only_fenced(sales: DataFrame) -> DataFrame:
    """``classify`` for amounts that are taken as they are, zero too: the fence is the only check."""
    marked = mark_outliers(sales, fence_limits(sales))
    return marked.withColumn("reason", F.when(F.col("is_outlier"), "outlier")).drop("is_outlier")


def clean(
    sales: DataFrame, run_day: dt.date | Column, tol: float = 0.10, k: float = 3.0, min_rows: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Valid rows with fallbacks filled in, and rejected rows with their reason."""
    classified = classify(sales, tol, k, min_rows)
    valid = fill_fallbacks(classified.filter("reason is null").drop("reason"), run_day)
    return valid, classified.filter("reason is not null")

