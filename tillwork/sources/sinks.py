"""Writers for sales and report tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.operators.periods import between


def write_sales(sales: DataFrame, path: str, mode: str = "append") -> None:
    """Sales as parquet by year and month, so period filters prune folders."""
    dated = sales.withColumns({"sale_year": F.year("sale_ts"), "sale_month": F.month("sale_ts")})
    # Rows of a month come together; the engine cuts months that are too large for a task.
    dated.hint("rebalance", "sale_year", "sale_month").write.mode(mode).partitionBy("sale_year", "sale_month").parquet(path)


def read_sales(spark: SparkSession, path: str, first: dt.date, end: dt.date) -> DataFrame:
    """Stored sales from ``first`` until before ``end``; folders of other months are not listed into the scan.

    Rows without a date lie in a folder of their own and belong to no period.
    """
    month = F.col("sale_year") * 12 + F.col("sale_month")
    last = end - dt.timedelta(days=1)
    stored = spark.read.parquet(path).filter(month.between(first.year * 12 + first.month, last.year * 12 + last.month))
    return stored.filter(between("sale_ts", first, end)).drop("sale_year", "sale_month")


def write_sales_csv(sales: DataFrame, path: str, mode: str = "append") -> None:
    sales.write.mode(mode).option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], path: str, as_of: dt.date, cadence: str, fmt: str = "parquet") -> dict[str, str]:
    """Each report table under ``path/<name>``, partitioned by run day and cadence."""
    written = {}
    for name, table in tables.items():
        target = f"{path}/{name}"
        stamped = table.withColumns({"as_of": F.lit(as_of), "run_cadence": F.lit(cadence)})
        (
            stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("as_of", "run_cadence").format(fmt).save(target)
        )
        written[name] = target
    return written
