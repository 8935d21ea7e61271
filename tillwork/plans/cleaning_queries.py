"""Queries on parsing, derived columns, row checks and the fence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.functions.dates import parse_date
from tillwork.functions.numbers import parse_number
from tillwork.operators import silver
from tillwork.plans.figure_queries import quartiles_sql
from tillwork.plans.registry import query
from tillwork.plans.views import EVENT_SALES_SQL, SALES_SQL, event_sales, sales_view, table

KEY = ["l_orderkey", "l_linenumber"]


def _cases(pick: Column, values: list[Column]) -> Column:
    chosen = F.when(pick == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        chosen = chosen.when(pick == i, value)
    return chosen


RUN_DAY = dt.date(2026, 6, 7)


@query("parse_numbers", """WITH src AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice AS x, (l_orderkey + l_linenumber) % 8 AS pick,
         translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS local FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE pick WHEN 0 THEN translate(local, '.,', '.')  WHEN 1 THEN local WHEN 2 THEN 'MZN ' || local
    WHEN 3 THEN replace(local, '.', ' ') || ' MT' WHEN 4 THEN 'N/A' WHEN 5 THEN local || 'eur'
    WHEN 6 THEN 'vinte' ELSE '-' || local END AS number_text,
  CASE WHEN pick = 0 THEN CAST(replace(replace(local, '.', ''), ',', '') AS DOUBLE)
    WHEN pick IN (4, 6) THEN NULL WHEN pick = 7 THEN -x ELSE x END AS number
FROM src""")
def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts written in several local ways and read back."""
    local = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    pick = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    text = _cases(pick, [
        F.translate(local, ".,", "."),
        local,
        F.concat(F.lit("MZN "), local),
        F.concat(F.replace(local, F.lit("."), F.lit(" ")), F.lit(" MT")),
        F.lit("N/A"),
        F.concat(local, F.lit("eur")),
        F.lit("vinte"),
        F.concat(F.lit("-"), local),
    ])
    lines = table(spark, sf, "lineitem").select(*KEY, text.alias("number_text"))
    return lines.withColumn("number", parse_number(F.col("number_text")))


@query("parse_dates", """WITH src AS (
  SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 11 AS pick,
         l_shipdate + to_hours(l_linenumber) + to_minutes(l_orderkey % 60) + to_seconds(l_orderkey % 59) AS t FROM lineitem),
txt AS (SELECT *, CASE pick WHEN 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(t, '%Y-%m-%d %H:%M')
    WHEN 2 THEN strftime(t, '%d/%m/%Y %H:%M:%S') WHEN 3 THEN strftime(t, '%d/%m/%Y %H:%M') WHEN 4 THEN strftime(t, '%Y-%m-%d')
    WHEN 5 THEN strftime(t, '%Y/%m/%d') WHEN 6 THEN strftime(t, '%d/%m/%Y') WHEN 7 THEN strftime(t, '%B %-d, %Y')
    WHEN 8 THEN strftime(t, '%d-%m-%Y') WHEN 9 THEN strftime(t, '%d/%m/%y') ELSE strftime(t, '%b %-d, %Y') END AS date_text FROM src)
SELECT l_orderkey, l_linenumber, date_text, strftime(
  CASE WHEN pick IN (0, 2) THEN t WHEN pick IN (1, 3) THEN date_trunc('minute', t) WHEN pick <= 8 THEN date_trunc('day', t)
       WHEN pick = 10 AND month(t) = 5 THEN date_trunc('day', t) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM txt""")
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Ship dates written in nine known and two unknown formats and read back (``May`` is short and full name)."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    at = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(
        hours=line, mins=(key % 60).cast("int"), secs=(key % 59).cast("decimal(18,6)")
    )
    formats = [
        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd",
        "yyyy/MM/dd", "dd/MM/yyyy", "MMMM d, yyyy", "dd-MM-yyyy", "dd/MM/yy", "MMM d, yyyy",
    ]
    text = _cases((key + line) % 11, [F.date_format(at, f) for f in formats])
    parsed = F.date_format(parse_date(F.col("date_text")), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "lineitem").select(*KEY, text.alias("date_text")).withColumn("parsed", parsed)


def _flawed_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales with flaws set by key: each kind of reject occurs, and amounts a thousandfold for the fence."""
    key = F.col("order_ref") * 7 + F.col("row_ix")
    null = F.lit(None)
    return sales_view(spark, sf).withColumns({
        "amount": F.when(key % 17 == 0, null).when(key % 19 == 0, -F.col("amount"))
        .when(key % 401 == 0, F.col("amount") * 1000).otherwise(F.col("amount")),
        "quantity": F.when(key % 29 == 0, F.lit(0.0)).otherwise(F.col("quantity")),
        "item": F.when(key % 31 == 0, null).otherwise(F.col("item")),
        "sale_ts": F.when(key % 37 == 0, null).otherwise(F.col("sale_ts")),
        "is_blank": key % 43 == 0,
        "order_cell": F.when(key % 23 == 0, F.lit("ORDER_ID")).otherwise(F.col("order_ref").cast("string")),
        "key": key,
    }).withColumn("order_ref", F.col("order_cell")).drop("order_cell")


FLAWED_SQL = f"""{SALES_SQL}, raw AS (
  SELECT client_id, row_ix, order_ref * 7 + row_ix AS key, CAST(order_ref AS VARCHAR) AS order_ref, amount AS a, quantity AS q, item AS i, sale_ts AS t FROM sv),
flawed AS (
  SELECT client_id, row_ix, key, CASE WHEN key % 23 = 0 THEN 'ORDER_ID' ELSE order_ref END AS order_ref,
    CASE WHEN key % 17 = 0 THEN NULL WHEN key % 19 = 0 THEN -a WHEN key % 401 = 0 THEN a * 1000 ELSE a END AS amount,
    CASE WHEN key % 29 = 0 THEN 0 ELSE q END AS quantity, CASE WHEN key % 31 = 0 THEN NULL ELSE i END AS item,
    CASE WHEN key % 37 = 0 THEN NULL ELSE t END AS sale_ts FROM raw),
checked AS (SELECT *, CASE WHEN key % 43 = 0 THEN 'blank_row' WHEN key % 23 = 0 THEN 'repeated_header'
    WHEN amount IS NULL OR amount <= 0 THEN 'bad_total' WHEN quantity <= 0 THEN 'bad_quantity' WHEN item IS NULL THEN 'missing_item' END AS r FROM flawed),
good AS (SELECT * FROM checked WHERE r IS NULL), {quartiles_sql('good', 'client_id')},
classified AS (SELECT c.*, coalesce(r, CASE WHEN total >= 4 AND q3 > q1 AND amount > q3 + 3 * (q3 - q1) THEN 'outlier'
    WHEN sale_ts IS NULL THEN 'bad_date' END) AS reason FROM checked c LEFT JOIN quart USING (client_id))"""


@query("silver_valid", f"""WITH {FLAWED_SQL}
SELECT client_id, order_ref, row_ix, item, quantity, amount, strftime(sale_ts, '%Y-%m-%d') AS day FROM classified WHERE reason IS NULL""")
def silver_valid(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = silver.clean(_flawed_sales(spark, sf).drop("key"), RUN_DAY)
    return valid.select("client_id", "order_ref", "row_ix", "item", "quantity", "amount", F.date_format("sale_ts", "yyyy-MM-dd").alias("day"))


@query("silver_rejects", f"WITH {FLAWED_SQL} SELECT client_id, key, reason FROM classified WHERE reason IS NOT NULL")
def silver_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, rejects = silver.clean(_flawed_sales(spark, sf), RUN_DAY)
    return rejects.select("client_id", "key", "reason")


@query("derived_columns", f"""WITH {SALES_SQL}, src AS (SELECT *, (order_ref + row_ix) % 5 AS kind FROM sv)
SELECT client_id, order_ref, row_ix, CASE kind WHEN 1 THEN unit_price * quantity WHEN 4 THEN 0 ELSE amount END AS amount,
  CASE WHEN kind IN (2, 4) THEN 1 ELSE quantity END AS quantity,
  CASE WHEN kind = 3 THEN '2026-06-07' ELSE strftime(sale_ts, '%Y-%m-%d') END AS day FROM src""")
def derived_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Sales without total, quantity, date, or total and quantity, by key."""
    kind = (F.col("order_ref") + F.col("row_ix")) % 5
    sales = sales_view(spark, sf, price=True).withColumns({
        "has_total": ~kind.isin(1, 4), "has_qty": ~kind.isin(2, 4), "has_date": kind != 3,
        "amount": F.when(~kind.isin(1, 4), F.col("amount")),
        "sale_ts": F.when(kind != 3, F.col("sale_ts")),
    })
    derived = silver.fill_fallbacks(silver.derive_total(sales), F.lit("2026-06-07").cast("date"))
    return derived.select("client_id", "order_ref", "row_ix", "amount", "quantity", F.date_format("sale_ts", "yyyy-MM-dd").alias("day"))


@query("cross_check", f"""WITH {SALES_SQL} SELECT client_id, order_ref, row_ix, quantity, unit_price, amount FROM sv
WHERE NOT (quantity > 0 AND unit_price > 0 AND abs(amount - quantity * unit_price) > quantity * unit_price * 0.10::DOUBLE)""")
def cross_check(spark: SparkSession, sf: str) -> DataFrame:
    kept = silver.cross_check(sales_view(spark, sf, items=False, price=True))
    return kept.select("client_id", "order_ref", "row_ix", "quantity", "unit_price", "amount")


@query("iqr_fence", f"""WITH {EVENT_SALES_SQL}, {quartiles_sql('ev', 'client_id')}
SELECT client_id, event_id, amount FROM ev JOIN quart USING (client_id)
WHERE NOT (total >= 4 AND q3 > q1 AND amount > q3 + 3 * (q3 - q1))""")
def iqr_fence(spark: SparkSession, sf: str) -> DataFrame:
    return silver.iqr_fence(event_sales(spark, sf)).select("client_id", F.col("row_ix").alias("event_id"), "amount")
