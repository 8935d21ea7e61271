"""Report tables and texts, one set per client, out of the key figures."""

from __future__ import annotations

import datetime as dt
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork import vocabulary
from tillwork.functions.text import fixed, is_service, money, safe_filename, signed_percent, strip, title_case
from tillwork.operators.kpis import with_shares
from tillwork.vocabulary import (
    CHANGE_LABEL,
    GOODS_LABELS,
    INSIGHT_NO_DATA,
    INSIGHT_PREFIX,
    PEAK_HOUR_LABEL,
    REVENUE_LABEL,
    SERVICE_LABELS,
)

DAILY, WEEKLY, MONTHLY = "diario", "semanal", "mensal"
_DAY = "dd/MM/yyyy"


def label(name: str, business_type: Column | None = None) -> Column:
    """Label for the row's kind of business."""
    kind = F.col("business_type") if business_type is None else business_type
    return F.when(is_service(kind), SERVICE_LABELS[name]).otherwise(GOODS_LABELS[name])


def labels(clients: DataFrame) -> DataFrame:
    """All labels per client."""
    return clients.select("client_id", *[label(n).alias(n) for n in GOODS_LABELS])


def _rows(df: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    entries = [F.struct(F.lit(i).alias("position"), l.alias("label"), v.alias("value")) for i, (l, v) in enumerate(pairs, 1)]
    return df.select("client_id", F.inline(F.array(*entries)))


def kpi_block(kpi_rows: DataFrame) -> DataFrame:
    """Four label and value rows per client."""
    return _rows(kpi_rows, [
        (F.lit(REVENUE_LABEL), money(F.col("total"))),
        (label("items_sold"), F.col("transactions").cast("string")),
        (label("avg_ticket"), money(F.col("avg_ticket"))),
        (label("best_day"), F.date_format("best_day", "yyyy-MM-dd")),
    ])


def highlights(kpi_rows: DataFrame) -> DataFrame:
    """Item of the day, peak hour and change against yesterday; ``-`` where missing."""
    item = F.col("item_of_day")
    item_text = F.concat(
        title_case(strip(item["item"])), F.lit("\n"), fixed(item["quantity"], 0), F.lit(vocabulary.UNITS), money(item["amount"])
    )
    change = F.concat(signed_percent(F.col("vs_yesterday_pct"), " "), F.lit(vocabulary.AGAINST_YESTERDAY))
    dash = F.lit("-")
    return _rows(kpi_rows, [
        (label("item_of_day"), F.coalesce(item_text, dash)),
        (F.lit(PEAK_HOUR_LABEL), F.coalesce("peak_hour", dash)),
        (F.lit(CHANGE_LABEL), F.coalesce(change, dash)),
    ])


def top_rows(top: DataFrame) -> DataFrame:
    """Ranked items with the texts of table and chart: shares, short names, bar lengths."""
    name = title_case(strip(F.col("item")))
    short = F.when(F.length("item") > 26, F.concat(F.substring("item", 1, 24), F.lit("..."))).otherwise(F.col("item"))
    return with_shares(top).withColumn("item", name).select(
        "client_id", "rank", "item", "quantity",
        F.concat(fixed(F.col("share_pct"), 1), F.lit(vocabulary.OF_TOP)).alias("share"),
        short.alias("short_name"),
        F.concat(fixed(F.col("quantity"), 0), F.lit(vocabulary.COUNT_UNITS)).alias("count_label"),
        F.concat(fixed(F.col("share_pct"), 0), F.lit(vocabulary.OF_TOTAL)).alias("share_label"),
        "ratio_to_max",
    )


def top_table(top: DataFrame) -> DataFrame:
    """Ranked items with their share of the listed volume."""
    return top_rows(top).select("client_id", "rank", "item", "quantity", "share")


def top_chart(top: DataFrame) -> DataFrame:
    """Bar lengths and short names of the ranked items."""
    return top_rows(top).select("client_id", "rank", "short_name", "count_label", "share_label", "ratio_to_max")


def insights(clients: DataFrame, top: DataFrame) -> DataFrame:
    """Recommendation built on the leading item, or the sentence for too little data."""
    leading = top.filter("rank = 1").select("client_id", F.upper(strip(F.col("item"))).alias("_leader"))
    parts = {"item": label("insight_item"), "leader": F.col("_leader"), "action": label("insight_action")}
    sentence = F.concat(*[
        part for text, name, _, _ in Formatter().parse(vocabulary.INSIGHT_LEADER)
        for part in (F.lit(text), *([parts[name]] if name else []))
    ])
    text = F.concat(F.lit(INSIGHT_PREFIX), F.coalesce(sentence, F.lit(INSIGHT_NO_DATA)))
    return clients.select("client_id", "business_type").join(leading, "client_id", "left").select("client_id", text.alias("insight"))


def summary_text(kpi_rows: DataFrame, as_of: dt.date) -> DataFrame:
    """Short message per client; its form depends on ``cadence``. Lines without a value are left out."""
    total, ticket = fixed(F.col("total"), 2), fixed(F.col("avg_ticket"), 2)
    count = F.col("transactions").cast("string")
    best_day = F.concat(F.lit(vocabulary.SUMMARY_BEST_DAY), F.date_format("best_day", "yyyy-MM-dd"))
    ticket_line = F.concat(label("summary_ticket"), F.lit(": "), ticket, F.lit(" MZN"))
    count_line = F.concat(label("summary_items"), F.lit(": "), count)
    revenue_line = F.concat(F.lit(vocabulary.SUMMARY_REVENUE), total, F.lit(" MZN"))
    item = F.col("item_of_day")
    monthly = F.concat_ws(
        "\n",
        F.concat(F.lit(vocabulary.SUMMARY_MONTH), F.col("month_name"), F.lit("):")),
        revenue_line,
        F.concat(F.lit(vocabulary.SUMMARY_TRANSACTIONS), count),
        ticket_line,
        best_day,
    )
    daily = F.concat_ws(
        "\n",
        F.concat(F.lit(vocabulary.SUMMARY_DAY), F.date_format(F.lit(as_of), _DAY), F.lit("):")),
        F.concat(F.lit(vocabulary.SUMMARY_DAY_REVENUE), total, F.lit(" MZN")),
        count_line,
        ticket_line,
        F.concat(label("summary_item_of_day"), F.lit(": "), item["item"], F.lit(" ("), fixed(item["quantity"], 0), F.lit(vocabulary.UNITS_OF_ITEM)),
        F.concat(F.lit(vocabulary.SUMMARY_PEAK_HOUR), F.col("peak_hour")),
        F.concat(F.lit(vocabulary.SUMMARY_CHANGE), signed_percent(F.col("vs_yesterday_pct"))),
    )
    weekly = F.concat_ws("\n", F.lit(vocabulary.SUMMARY_WEEK), revenue_line, count_line, ticket_line, best_day)
    text = F.when(F.col("cadence") == MONTHLY, monthly).when(F.col("cadence") == DAILY, daily).otherwise(weekly)
    return kpi_rows.select("client_id", text.alias("summary"))


def top_text(clients: DataFrame, top: DataFrame) -> DataFrame:
    """Numbered list of the leading items; a client without items is told so.

    ``clients`` has ``client_id``, ``business_type`` and ``cadence``. The gathered list holds
    five lines per client.
    """
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("item"), F.lit(" - "), fixed(F.col("quantity"), 0), F.lit(vocabulary.OCCURRENCES)
    )
    listed = top.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))["line"].alias("_lines"))
    heading = F.concat(F.lit(vocabulary.TOP_HEADING), label("plural"), F.lit(" ("), F.col("cadence"), F.lit("):\n"))
    none = F.concat(F.lit(vocabulary.TOP_NONE), label("plural"), F.lit(vocabulary.TOP_NONE_END))
    text = F.coalesce(F.concat(heading, F.array_join("_lines", "\n")), none)
    return clients.join(listed, "client_id", "left").select("client_id", text.alias("top_text"))


def period_label(clients: DataFrame, as_of: dt.date) -> DataFrame:
    """Heading period and file name of each client's report.

    A report may carry its own name in ``report_label``: a generated name (one with an underscore)
    becomes the file name, any other text the heading of a report that is not daily.
    """
    own = F.col("report_label")
    generated = F.coalesce(own.contains("_"), F.lit(False))
    day = F.date_format(F.lit(as_of), _DAY)
    month = F.concat(F.lit(vocabulary.MONTH_OF), F.date_format(F.lit(as_of), "MMMM"))
    week = F.concat(F.lit(vocabulary.WEEK_UNTIL), day)
    heading = (
        F.when(F.col("cadence") == DAILY, F.concat(F.lit(vocabulary.DAY_HEADING), day))
        .when(generated, F.concat(F.lit(vocabulary.PERIOD_UNTIL), day))
        .otherwise(F.coalesce(F.nullif(own, F.lit("")), F.when(F.col("cadence") == MONTHLY, month).otherwise(week)))
    )
    file_name = F.when(generated, own).otherwise(F.concat(safe_filename(F.lower("name")), F.lit(vocabulary.REPORT_NAME_END)))
    return clients.select("client_id", heading.alias("period_label"), file_name.alias("report_name"))

