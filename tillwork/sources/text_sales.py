"""Sales typed as text, one ``item, quantity, value`` per line."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.numbers import is_decimal, parse_decimal
from tillwork.functions.text import fields, lines, strip


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("*", F.posexplode(lines(F.col("text"))).alias("line_no", "line"))


def _numbers(rows: DataFrame) -> DataFrame:
    parts = rows.withColumn("parts", fields(F.col("line")))
    return parts.withColumns({
        "quantity": parse_decimal(F.get("parts", F.lit(1))),
        "amount": parse_decimal(F.get("parts", F.lit(2))),
    })


def text_lines(texts: DataFrame) -> DataFrame:
    """Non-blank lines with their parts and, if unusable, a ``reason``."""
    numbers = _numbers(_lines(texts).filter(strip(F.col("line")) != ""))
    reason = F.when(F.size("parts") != 3, "not_three_fields").when(
        F.col("quantity").isNull() | F.col("amount").isNull(), "not_numeric"
    )
    return numbers.withColumn("reason", reason)


def text_sales(texts: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Usable lines as sales, dated with ``as_of`` or else the day the text was received.

    ``texts`` has ``client_id``, ``business_type``, ``text``, ``received_at`` and a ``source_id``.
    """
    day = F.to_date("received_at") if as_of is None else F.lit(as_of)
    no, yes = F.lit(False), F.lit(True)
    # Counting commas drops most unusable lines before anything is split.
    commas = F.length("line") - F.length(F.replace("line", F.lit(","), F.lit("")))
    # Spark repeats what a filter reads for every use of it, so the filters test short texts that plain cuts give.
    line = F.col("line")
    parts = _lines(texts).filter(commas == 2).withColumns({
        "item": strip(F.substring_index(line, ",", 1)),
        "quantity": strip(F.substring_index(F.substring_index(line, ",", 2), ",", -1)),
        "amount": strip(F.substring_index(line, ",", -1)),
    })
    usable = parts.filter(is_decimal(F.col("quantity")) & is_decimal(F.col("amount"))).withColumns({
        c: F.col(c).try_cast("double") for c in ("quantity", "amount")
    }).filter((F.abs("quantity") < float("inf")) & (F.abs("amount") < float("inf")))
    return usable.select(
        "client_id", "source_id", F.col("line_no").cast("long").alias("row_ix"), "business_type",
        day.cast("timestamp_ntz").alias("sale_ts"),
        "item", "quantity",
        F.lit(None).cast("double").alias("unit_price"), "amount",
        F.lit(None).cast("string").alias("order_ref"), F.lit(None).cast("string").alias("order_name"),
        no.alias("is_blank"), yes.alias("has_date"), yes.alias("has_total"), no.alias("has_price"),
        yes.alias("has_qty"), yes.alias("has_item"), no.alias("has_order"),
    )
