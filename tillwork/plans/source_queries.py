"""Queries on sources: headers, CSV files, page tables, text sales, message events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.operators import align
from tillwork.plans.registry import query
from tillwork.plans.reporting import ingest
from tillwork.plans.views import table
from tillwork.sources.csv_files import read_csv_sources
from tillwork.sources.events import extract_messages
from tillwork.sources.page_tables import read_page_tables
from tillwork.sources.text_sales import text_lines, text_sales
from tillwork.staging import new_path, stage
from tillwork.vocabulary import (
    DATE_ROLE_WORDS,
    FIELD_WORDS,
    GOODS_WORDS,
    MISSING_WORDS,
    ORDER_ROLE_NAMES,
    PRICE_ROLE_WORDS,
    QUANTITY_ROLE_WORDS,
    SERVICE_WORDS,
    TOTAL_ROLE_WORDS,
)

# Header names from which each customer's header is drawn, five at a time, by key.
HEADER_NAMES = [
    "data", "Date", "Valor", "valor", "Total", "quantidade", "Qty", "produto", "Servico", "Unit Price", "Discount",
    "Media", "subtotal", "ID", "fatura", "dia", "Amount", "descricao", "nome", " VALUE ", "preco_total", "transaction date", "", None,
]
_STEPS = [1, 5, 7, 11, 13]


def _header(key: Column) -> Column:
    names = F.array(*[F.lit(n) for n in HEADER_NAMES])
    pick = lambda i, step: F.pmod(F.floor(key / (i + 1)) * step + i * 3, F.lit(len(HEADER_NAMES))).cast("int")
    return F.array(*[F.get(names, pick(i, step)) for i, step in enumerate(_STEPS)])


def _sql_names(names: list) -> str:
    return "[" + ", ".join("NULL" if n is None else f"'{n}'" for n in names) + "]"


def _any(name: str, words: list[str]) -> str:
    return f"list_bool_or([contains({name}, w) for w in {_sql_names(words)}])"


def _first_sql(test: str) -> str:
    return f"nullif(list_position([coalesce({test}, false) for x in names], true), 0)"


def _greedy_sql() -> str:
    """Column by column: each takes the first field still free. One CTE per column."""
    fields = list(FIELD_WORDS)
    ctes = []
    for i in range(1, len(_STEPS) + 1):
        previous = "direct" if i == 1 else f"g{i - 1}"
        name = f"low[{i}]"
        taken = " OR ".join(f"coalesce({f}_direct = {i}, false)" for f in fields)
        blocked = f"({name} IS NULL OR complete OR {taken})"
        parts, earlier = [], "false"
        for f in fields:
            hit = f"(NOT {blocked} AND NOT ({earlier}) AND {f} IS NULL AND coalesce({_any(name, FIELD_WORDS[f])}, false))"
            parts.append(f"CASE WHEN {hit} THEN {i} ELSE {f} END AS {f}")
            earlier = f"{earlier} OR ({f} IS NULL AND coalesce({_any(name, FIELD_WORDS[f])}, false))"
        ctes.append(f"g{i} AS (SELECT k, kind, low, complete, {', '.join(f'{f}_direct' for f in fields)}, {', '.join(parts)} FROM {previous})")
    return ",\n".join(ctes)


_PICKS_SQL = ", ".join(
    f"{_sql_names(HEADER_NAMES)}[1 + CAST(((c_custkey // {i + 1}) * {s} + {i * 3}) % {len(HEADER_NAMES)} AS BIGINT)]" for i, s in enumerate(_STEPS)
)
ALIGN_SQL = f"""WITH src AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'retalho' WHEN 1 THEN 'servicos' ELSE 'outro' END AS kind,
  [{_PICKS_SQL}] AS header FROM customer),
lowered AS (SELECT k, kind, [nullif(trim(lower(x)), '') for x in header] AS low FROM src),
direct0 AS (SELECT *, {', '.join(f"nullif(list_position(low, '{f}'), 0) AS {f}_direct" for f in FIELD_WORDS)} FROM lowered),
direct AS (SELECT *, data_direct IS NOT NULL AND valor_direct IS NOT NULL AS complete, {', '.join(f'{f}_direct AS {f}' for f in FIELD_WORDS)} FROM direct0),
{_greedy_sql()},
named AS (SELECT k, kind, [CASE {' '.join(f"WHEN i = {f} THEN '{f}'" for f in FIELD_WORDS)} ELSE low[i] END for i in range(1, {len(_STEPS) + 1})] AS names FROM g{len(_STEPS)}),
roles AS (SELECT *, {_first_sql(_any('x', TOTAL_ROLE_WORDS))} AS total_ix, {_first_sql(_any('x', DATE_ROLE_WORDS))} AS date_ix,
  {_first_sql(_any('x', QUANTITY_ROLE_WORDS))} AS quantity_ix, {_first_sql(f"list_contains({_sql_names(ORDER_ROLE_NAMES)}, x)")} AS order_ix,
  {_first_sql(_any('x', GOODS_WORDS))} AS goods, {_first_sql(_any('x', SERVICE_WORDS))} AS services, {_first_sql(_any('x', GOODS_WORDS + SERVICE_WORDS))} AS either FROM named)
SELECT k AS customer, array_to_string([coalesce(x, '-') for x in names], ',') AS names, total_ix, date_ix, quantity_ix, order_ix,
  nullif(list_position([coalesce({_any('names[i]', PRICE_ROLE_WORDS)}, false) AND i IS DISTINCT FROM total_ix for i in range(1, {len(_STEPS) + 1})], true), 0) AS price_ix,
  CASE kind WHEN 'retalho' THEN coalesce(goods, services) WHEN 'servicos' THEN coalesce(services, goods) ELSE either END AS item_ix,
  CASE WHEN list_contains(names, 'data') AND list_contains(names, 'valor') THEN 'ok' ELSE 'missing_columns' END AS status
FROM roles"""


@query("align_headers", ALIGN_SQL)
def align_headers(spark: SparkSession, sf: str) -> DataFrame:
    """A header drawn for every customer, mapped to fields and roles."""
    key = F.col("c_custkey")
    headers = table(spark, sf, "customer").select(
        key.cast("string").alias("source_id"), _header(key).alias("header"),
        F.when(key % 3 == 0, "retalho").when(key % 3 == 1, "servicos").otherwise("outro").alias("business_type"),
    )
    mapped = align.map_headers(headers)
    names = F.array_join(F.transform("names", lambda n: F.coalesce(n, F.lit("-"))), ",")
    return mapped.select(
        F.col("source_id").cast("long").alias("customer"), names.alias("names"), *[f"{r}_ix" for r in align.ROLES], "status"
    )


def _no_clients(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.lit("").alias("client_id"), F.lit("").alias("business_type"))


@query("csv_union", """SELECT 'v' || o_orderkey % 4 AS client_id, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderkey AS VARCHAR) END AS order_ref,
  o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 9 + 1 AS DOUBLE) END AS quantity FROM orders""")
def csv_union(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as CSV under four different headers, then read back as one table.

    One column holds nothing but words for "missing", another holds them in every fifth row.
    """
    folder = new_path(spark, "csv")
    orders = table(spark, sf, "orders")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    iso, local = F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy")
    comma = F.concat(F.translate(F.format_number("o_totalprice", 2), ",.", ".,"), F.lit(" MT"))
    missing = F.get(F.array(*[F.lit(w) for w in MISSING_WORDS]), (key % len(MISSING_WORDS)).cast("int"))
    pieces = F.when(key % 5 == 0, missing).otherwise((key % 9 + 1).cast("string"))
    variants = [
        [iso.alias("data"), key.alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("valor")],
        [comma.alias("Total"), local.alias("Date"), missing.alias("vazio"), key.alias("invoice")],
        [F.col("o_orderstatus").alias("estado"), pieces.alias("Qty"), iso.alias("dia"), comma.alias("montante")],
        [F.concat(F.lit('a, "b" '), key.cast("string")).alias("nota"), comma.alias("VALOR"), local.alias("periodo")],
    ]
    for i, columns in enumerate(variants):
        part = orders.filter(key % 4 == i).select(*columns)
        part.write.option("header", True).option("escape", '"').csv(f"{folder}/v{i}")
    sources, raw = read_csv_sources(spark, [folder])
    sales, _ = ingest(sources, raw, _no_clients(spark))
    return sales.select("client_id", "order_ref", "amount", F.date_format("sale_ts", "yyyy-MM-dd").alias("day"), "quantity")


def _page_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as page tables: one page per thousand order numbers, three header layouts."""
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    page = F.floor(key / 1000)
    date, price = F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_number("o_totalprice", 2)
    price = F.translate(price, ",.", ".,")
    status, null = F.col("o_orderstatus"), F.lit(None).cast("string")
    row = (
        F.when(page % 3 == 0, F.array(date, price, status))
        .when(page % 3 == 1, F.array(price, key.cast("string"), date))
        .otherwise(F.array(date, key.cast("string"), price, status))
    )
    header = (
        F.when(page % 3 == 0, F.array(F.lit("data"), F.lit("valor"), null))
        .when(page % 3 == 1, F.array(F.lit("valor"), F.lit("id"), F.lit("data")))
        .otherwise(F.array(F.lit("data"), F.lit(""), F.lit("valor"), F.lit("estado")))
    )
    client = F.concat(F.lit("c"), (page % 2).cast("string"))
    rows = orders.select(client.alias("client_id"), page.alias("page"), header.alias("header"), row.alias("row"))
    tables = rows.groupBy("client_id", "page", "header").agg(F.collect_list("row").alias("rows"))
    return stage(tables.select(
        F.concat(F.col("client_id"), F.lit(".pdf")).alias("source_id"), "client_id", "page",
        F.lit(0).alias("table_ix"), F.concat(F.array("header"), F.col("rows")).alias("cells"),
    ), "pages")


@query("table_union", """SELECT 'c' || (o_orderkey // 1000) % 2 AS client_id, o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN (o_orderkey // 1000) % 3 = 1 THEN CAST(o_orderkey AS VARCHAR) END AS order_ref FROM orders""")
def table_union(spark: SparkSession, sf: str) -> DataFrame:
    sources, raw = read_page_tables(_page_tables(spark, sf))
    sales, _ = ingest(sources, raw, _no_clients(spark))
    return sales.select("client_id", "amount", F.date_format("sale_ts", "yyyy-MM-dd").alias("day"), "order_ref")


@query("source_status", """WITH pages AS (SELECT (o_orderkey // 1000) % 2 AS c, count(*) AS n FROM orders GROUP BY 1)
SELECT 'c' || c AS client_id, n AS rows, 'ok' AS status FROM pages
UNION ALL SELECT 'c' || c || '-none', 0, 'empty' FROM pages
UNION ALL SELECT 'c' || c || '-other', 0, 'unsupported_format' FROM pages
UNION ALL SELECT 'c' || c || '-bare', n, 'missing_columns' FROM pages""")
def source_status(spark: SparkSession, sf: str) -> DataFrame:
    """Good, empty, unsupported and unusable sources side by side."""
    pages = _page_tables(spark, sf)
    # Copies of the pages under the header names a, b, c, d, in which nothing can be recognised.
    bare = F.transform(
        "cells",
        lambda row, i: F.when(i == 0, F.transform(row, lambda _, j: F.element_at(F.array(*map(F.lit, "abcd")), j + 1))).otherwise(row),
    )
    renamed = pages.withColumns({
        "cells": bare, "client_id": F.concat("client_id", F.lit("-bare")), "source_id": F.concat(F.lit("bare-"), "source_id"),
    })
    sources, raw = read_page_tables(pages.unionByName(renamed))
    plain = sources.filter("client_id not like '%-bare'")
    extra = lambda fmt, tail: plain.select(
        F.concat(F.lit(f"{tail}-"), "source_id").alias("source_id"), F.concat("client_id", F.lit(f"-{tail}")).alias("client_id"),
        F.lit(fmt).alias("format"), F.lit(None).cast("array<string>").alias("header"),
    )
    listed = sources.unionByName(extra("csv", "none")).unionByName(extra("txt", "other"))
    _, status = ingest(listed, raw, _no_clients(spark))
    return status.select("client_id", "rows", "status")


@query("text_sales", """WITH src AS (SELECT l_orderkey, l_linenumber, p_name, l_quantity, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey || '-' || l_linenumber AS client_id, p_name AS item, l_quantity AS quantity, l_extendedprice AS amount, '2026-06-07' AS day FROM src
UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'Extra', 1, CAST(l_linenumber AS DOUBLE), '2026-06-07' FROM src WHERE l_orderkey % 2 = 0""")
def text_sales_query(spark: SparkSession, sf: str) -> DataFrame:
    """A chat text per order line, with heading, blank and unusable lines around the sales."""
    joined = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    text = F.concat(
        F.lit("produto, quantidade, valor\r\n"), F.col("p_name"), F.lit(" ,  "), F.col("l_quantity").cast("string"), F.lit(","),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("\n\n Arroz, 2,5, 80\nFeijao, 2\nX, nan, 5\n"),
        F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("Extra, 1, "), F.col("l_linenumber").cast("string"))).otherwise(F.lit("fim")),
    )
    texts = joined.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("client_id"),
        F.lit("chat").alias("source_id"), F.lit("retalho").alias("business_type"), text.alias("text"),
        F.lit("2026-06-07 10:00:00").cast("timestamp").alias("received_at"),
    )
    return text_sales(texts).select("client_id", "item", "quantity", "amount", F.date_format("sale_ts", "yyyy-MM-dd").alias("day"))


@query("text_line_rejects", """SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no, 'not_three_fields' AS reason
FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM conversations)
WHERE trim(line) <> '' AND len(string_split(line, ',')) <> 3
UNION ALL SELECT conv_id, turn, CAST(line_no AS INTEGER), 'not_numeric'
FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM conversations)
WHERE trim(line) <> '' AND len(string_split(line, ',')) = 3""")
def text_line_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation texts hold no sales, so every line has a reason."""
    return text_lines(table(spark, sf, "conversations")).filter("reason is not null").select("conv_id", "turn", "line_no", "reason")


def _event_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as event JSON: text, document, two messages at once, none, or broken."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    ident = F.concat(F.lit("m-"), conv, F.lit("-"), turn)
    phone = F.concat(F.lit("+2588400"), conv)
    null = F.lit(None).cast("string")

    def message(tail: str, kind: Column, body: Column, doc: Column) -> Column:
        return F.struct(
            F.concat(ident, F.lit(tail)).alias("id"), phone.alias("from"), kind.alias("type"),
            F.when(body.isNotNull(), F.struct(body.alias("body"))).alias("text"),
            F.when(doc.isNotNull(), F.struct(doc.alias("id"), F.when(F.col("turn") % 2 == 0, F.lit("vendas.csv")).alias("filename"))).alias("document"),
        )

    text = message("", F.lit("text"), F.col("text"), null)
    document = message("b", F.lit("document"), null, F.concat(F.lit("d"), turn))
    pick = (F.col("conv_id") + F.col("turn")) % 5
    messages = F.when(pick == 0, F.array(text)).when(pick == 1, F.array(document)).when(pick == 2, F.array(text, document))
    event = F.struct(F.array(F.struct(F.array(F.struct(F.struct(messages.alias("messages")).alias("value"))).alias("changes"))).alias("entry"))
    body = F.when(pick == 4, F.lit('{"entry": [{')).otherwise(F.to_json(event))
    at = F.lit("2026-06-07 08:00:00").cast("timestamp")
    return table(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"), at.alias("event_ts"))


@query("event_extract", """WITH src AS (SELECT *, (conv_id + turn) % 5 AS pick FROM conversations)
SELECT 'm-' || conv_id || '-' || turn AS message_id, '2588400' || conv_id AS client_id, 'text' AS type, text, NULL AS document_id, NULL AS filename
FROM src WHERE pick IN (0, 2)
UNION ALL SELECT 'm-' || conv_id || '-' || turn || 'b', '2588400' || conv_id, 'document', NULL, 'd' || turn,
  CASE WHEN turn % 2 = 0 THEN 'vendas.csv' ELSE 'vendas_1780819200.xlsx' END FROM src WHERE pick IN (1, 2)""")
def event_extract(spark: SparkSession, sf: str) -> DataFrame:
    messages = extract_messages(_event_bodies(spark, sf))
    return messages.select("message_id", "client_id", "type", "text", "document_id", "filename")


@query("event_first_only", """SELECT 'm-' || conv_id || '-' || turn || CASE WHEN (conv_id + turn) % 5 = 1 THEN 'b' ELSE '' END AS message_id,
  CASE WHEN (conv_id + turn) % 5 = 1 THEN 'document' ELSE 'text' END AS type FROM conversations WHERE (conv_id + turn) % 5 IN (0, 1, 2)""")
def event_first_only(spark: SparkSession, sf: str) -> DataFrame:
    return extract_messages(_event_bodies(spark, sf), first_only=True).select("message_id", "type")
