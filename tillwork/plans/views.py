"""Sales, client and message views over the driver tables, in Spark and as SQL for the checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flags(**known: bool) -> dict[str, Column]:
    names = ["date", "total", "price", "qty", "item", "order"]
    return {f"has_{n}": F.lit(known.get(n, True)) for n in names}


def sales_view(spark: SparkSession, sf_dir: str, items: bool = True, price: bool = False) -> DataFrame:
    """Order lines as sales of customers. ``items`` joins the part names; figures without items skip that join."""
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select(columns)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if items or price:
        joined = joined.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("o_custkey").alias("client_id"),
        F.lit("lineitem").alias("source_id"),
        F.col("l_linenumber").cast("long").alias("row_ix"),
        F.lit("retalho").alias("business_type"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("sale_ts"),
        (F.col("p_name") if items else F.lit(None).cast("string")).alias("item"),
        F.col("l_quantity").alias("quantity"),
        (F.col("p_retailprice") if price else F.lit(None).cast("double")).alias("unit_price"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_orderkey").alias("order_ref"),
        F.lit("order_id").alias("order_name"),
        F.lit(False).alias("is_blank"),
    ).withColumns(_flags(price=price, item=items))


SALES_SQL = """sv AS (
  SELECT o.o_custkey AS client_id, l.l_linenumber AS row_ix, l.l_shipdate AS sale_ts, p.p_name AS item,
         l.l_quantity AS quantity, p.p_retailprice AS unit_price, l.l_extendedprice AS amount,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS cents, l.l_orderkey AS order_ref
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""


def event_sales(spark: SparkSession, sf_dir: str, business_type: str = "retalho") -> DataFrame:
    """Events as sales of users: no quantity column, no order references."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("client_id"),
        F.lit("events").alias("source_id"),
        F.col("event_id").alias("row_ix"),
        F.lit(business_type).alias("business_type"),
        F.col("ts").cast("timestamp_ntz").alias("sale_ts"),
        F.col("event_type").alias("item"),
        F.lit(1.0).alias("quantity"),
        F.lit(None).cast("double").alias("unit_price"),
        F.col("value").alias("amount"),
        F.lit(None).cast("string").alias("order_ref"),
        F.lit(None).cast("string").alias("order_name"),
        F.lit(False).alias("is_blank"),
    ).withColumns(_flags(price=False, qty=False, order=False))


EVENT_SALES_SQL = """ev AS (
  SELECT user_id AS client_id, event_id, ts AS sale_ts, CAST(ts AS DATE) AS day, event_type AS item, value AS amount,
         CAST(value AS DECIMAL(18,2)) AS cents FROM events),
as_of AS (SELECT max(CAST(ts AS DATE)) AS d FROM events)"""


def last_day(df: DataFrame, ts: str) -> dt.date:
    """Latest day of a table: one value, used as a literal so that period filters reach the scan."""
    return df.agg(F.max(F.to_date(ts))).first()[0]


# Chat words that the derived messages use.
CHAT_WORDS = ["5", "6", "1", "2", "3", "cancelar", "ola", "Loja Azul", "4", "vendas", "Frango, 2, 30"]


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chat messages: every user is a client, the word comes from the event number."""
    words = F.array(*[F.lit(w) for w in CHAT_WORDS])
    pick = F.pmod(F.col("event_id") * 7 + F.floor(F.col("event_id") / 13), F.lit(len(CHAT_WORDS))).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("client_id"),
        F.format_string("m%010d", F.col("event_id")).alias("message_id"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.get(words, pick).alias("text"),
    )


CHAT_SQL = """chat AS (
  SELECT CAST(user_id AS VARCHAR) AS client_id, format('m{:010d}', event_id) AS message_id, ts AS event_ts,
         list_extract([%s], 1 + CAST((event_id * 7 + event_id // 13) %% %d AS BIGINT)) AS text,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events)""" % (", ".join(f"'{w}'" for w in CHAT_WORDS), len(CHAT_WORDS))


def client_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the client table, with gaps, cadences and registration steps set by key."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("client_id"),
        F.when(key % 9 != 0, F.col("c_name")).alias("name"),
        F.when(key % 5 == 0, "").when(key % 5 == 1, "servicos").when(key % 5 == 2, "agropecuaria")
        .when(key % 5 == 3, "retalho").alias("business_type"),
        F.when(key % 4 == 0, "diario").when(key % 4 == 1, "semanal").when(key % 4 == 2, "mensal").alias("cadence"),
        F.when(key % 3 != 0, F.concat(F.lit("uploads/"), key.cast("string"), F.lit(".csv"))).alias("last_file"),
        F.lit(None).cast("string").alias("last_report"),
        F.when(key % 6 == 0, key % 4).otherwise(0).cast("int").alias("onboarding_step"),
        F.when(key % 7 == 0, '["a","b"]').when(key % 7 != 1, "[]").alias("history"),
        F.lit(None).cast("string").alias("mode"),
        F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )


CLIENTS_SQL = """clients AS (
  SELECT CAST(c_custkey AS VARCHAR) AS client_id, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS name,
         CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'servicos' WHEN 2 THEN 'agropecuaria' WHEN 3 THEN 'retalho' END AS business_type,
         CASE c_custkey % 4 WHEN 0 THEN 'diario' WHEN 1 THEN 'semanal' WHEN 2 THEN 'mensal' END AS cadence,
         CASE WHEN c_custkey % 3 <> 0 THEN 'uploads/' || c_custkey || '.csv' END AS last_file,
         CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 4 ELSE 0 END AS onboarding_step,
         CASE WHEN c_custkey % 7 = 0 THEN '["a","b"]' WHEN c_custkey % 7 <> 1 THEN '[]' END AS history,
         c_custkey AS k
  FROM customer)"""
