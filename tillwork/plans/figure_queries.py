"""Queries on key figures, rankings and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.operators import kpis, periods, report
from tillwork.operators.quantiles import quartiles
from tillwork.plans.registry import query
from tillwork.plans.reporting import key_figures
from tillwork.plans.views import CLIENTS_SQL, EVENT_SALES_SQL, SALES_SQL, client_table, event_sales, last_day, sales_view, table
from tillwork.sources.sinks import write_sales
from tillwork.staging import new_path

DAY = "yyyy-MM-dd"
LATEST_SHIP_SQL = "last_ship AS (SELECT max(CAST(l_shipdate AS DATE)) AS d FROM lineitem)"


def _day(name: str):
    return F.date_format(name, DAY).alias(name)


def best_day_sql(source: str, name: str = "best") -> str:
    return f"""{name}_days AS (SELECT client_id, CAST(sale_ts AS DATE) AS day, sum(cents) AS revenue FROM {source} GROUP BY ALL),
{name} AS (SELECT client_id, day AS best_day FROM {name}_days
  QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY revenue DESC, day) = 1)"""


def top_sql(source: str, quantity: str, weight: str, name: str = "top", n: int = 5) -> str:
    return f"""{name} AS (
  SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY weight DESC, item) AS rank, item, quantity, amount
  FROM (SELECT client_id, item, CAST(trunc({quantity}) AS BIGINT) AS quantity, CAST(sum(cents) AS DOUBLE) AS amount,
               {weight} AS weight FROM {source} GROUP BY client_id, item)
  QUALIFY rank <= {n})"""


def peak_sql(source: str) -> str:
    return f"""peak AS (
  SELECT client_id, CASE WHEN count(*) OVER (PARTITION BY client_id) > 1
         THEN format('{{:02d}}h-{{:02d}}h', hour, hour + 1) END AS peak_hour
  FROM (SELECT client_id, CAST(hour(sale_ts) AS INTEGER) AS hour, count(*) AS n FROM {source} GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY n DESC, hour) = 1)"""


def change_sql(source: str, as_of: str) -> str:
    return f"""change AS (
  SELECT client_id, CASE WHEN before IS NOT NULL AND today IS NOT NULL AND before <> 0
         THEN CAST(format('{{:.1f}}', (today - before) / before * 100) AS DOUBLE) END AS vs_yesterday_pct
  FROM (SELECT client_id,
          CAST(sum(cents) FILTER (CAST(sale_ts AS DATE) = {as_of}) AS DOUBLE) AS today,
          CAST(sum(cents) FILTER (CAST(sale_ts AS DATE) = {as_of} - 1) AS DOUBLE) AS before
        FROM {source} GROUP BY client_id))"""


SV_TOP = top_sql("sv", "sum(CAST(quantity AS DECIMAL(18,2)))", "sum(CAST(quantity AS DECIMAL(18,2)))")


@query("kpi_by_client", f"""WITH {SALES_SQL}, {best_day_sql('sv')}
SELECT client_id, CAST(sum(cents) AS DOUBLE) AS total, count(DISTINCT order_ref) AS transactions,
       CAST(sum(cents) AS DOUBLE) / count(DISTINCT order_ref) AS avg_ticket,
       strftime(any_value(best_day), '%Y-%m-%d') AS best_day
FROM sv JOIN best USING (client_id) GROUP BY client_id""")
def kpi_by_client(spark: SparkSession, sf: str) -> DataFrame:
    rows = kpis.kpis(sales_view(spark, sf, items=False))
    return rows.select("client_id", "total", "transactions", "avg_ticket", _day("best_day"))


@query("revenue_by_day", f"""WITH {SALES_SQL}
SELECT client_id, strftime(CAST(sale_ts AS DATE), '%Y-%m-%d') AS day, CAST(sum(cents) AS DOUBLE) AS revenue, count(*) AS rows
FROM sv GROUP BY ALL""")
def revenue_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.by_day(sales_view(spark, sf, items=False)).select("client_id", _day("day"), "revenue", "rows")


@query("sales_sink", f"""WITH {SALES_SQL}
SELECT CAST(year(sale_ts) AS INTEGER) AS sale_year, CAST(month(sale_ts) AS INTEGER) AS sale_month, CAST(sum(cents) AS DOUBLE) AS revenue, count(*) AS rows
FROM sv GROUP BY ALL""")
def sales_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Sales written by year and month, and read back by folder."""
    path = new_path(spark, "sink")
    write_sales(sales_view(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("sale_year", "sale_month").agg(kpis.exact_sum("amount").alias("revenue"), F.count("*").alias("rows"))


@query("extreme_values", f"""WITH {SALES_SQL}, planted AS (SELECT client_id, item,
    CASE (order_ref + row_ix) % 50 WHEN 0 THEN 1e15 WHEN 1 THEN 1e30 ELSE amount END AS amount,
    CASE (order_ref + row_ix) % 50 WHEN 2 THEN 1e20 WHEN 3 THEN 1e30 ELSE quantity END AS quantity, cents, (order_ref + row_ix) % 50 < 4 AS odd FROM sv)
SELECT client_id, count(*) AS rows, CAST(sum(cents) FILTER (NOT odd) AS DOUBLE) AS plain_total, max(amount) AS most,
       sum(amount) >= 1e15 AS far, any_value(top_quantity) AS top_quantity
FROM planted JOIN (SELECT client_id, CAST(format('{{:.4g}}', max(q)) AS DOUBLE) AS top_quantity FROM
  (SELECT client_id, item, trunc(sum(quantity)) AS q FROM planted GROUP BY client_id, item) GROUP BY client_id) USING (client_id) GROUP BY client_id""")
def extreme_values(spark: SparkSession, sf: str) -> DataFrame:
    """Sales with totals of 1e15 and 1e30 and quantities of 1e20 and 1e30 planted by key: nothing stops or is dropped."""
    pick = (F.col("order_ref") + F.col("row_ix")) % 50
    planted = sales_view(spark, sf).withColumns({
        "amount": F.when(pick == 0, 1e15).when(pick == 1, 1e30).otherwise(F.col("amount")),
        "quantity": F.when(pick == 2, 1e20).when(pick == 3, 1e30).otherwise(F.col("quantity")), "odd": pick < 4,
    })
    # Four digits, since doubles of this size are not added in one order.
    top = kpis.top_items(planted, 1).select("client_id", F.format_string("%.3e", "quantity").cast("double").alias("top_quantity"))
    sums = planted.groupBy("client_id").agg(
        F.count("*").alias("rows"), kpis.exact_sum(F.when(~F.col("odd"), F.col("amount"))).alias("plain_total"), F.max("amount").alias("most"),
        (kpis.exact_sum("amount") >= 1e15).alias("far"),
    )
    return sums.join(top, "client_id")


@query("daily_change", f"""WITH {EVENT_SALES_SQL},
days AS (SELECT client_id, day, CAST(sum(cents) AS DOUBLE) AS revenue, count(*) AS rows FROM ev GROUP BY ALL)
SELECT a.client_id, strftime(a.day, '%Y-%m-%d') AS day, a.revenue, a.rows, b.revenue AS revenue_before,
       CASE WHEN b.revenue <> 0 THEN CAST(format('{{:.1f}}', (a.revenue - b.revenue) / b.revenue * 100) AS DOUBLE) END AS change_pct
FROM days a LEFT JOIN days b ON a.client_id = b.client_id AND a.day = b.day + 1""")
def daily_change(spark: SparkSession, sf: str) -> DataFrame:
    days = kpis.daily_change(kpis.by_day(event_sales(spark, sf)))
    return days.select("client_id", _day("day"), "revenue", "rows", "revenue_before", "change_pct")


@query("top5_items_by_client", f"WITH {SALES_SQL}, {SV_TOP} SELECT * REPLACE (CAST(quantity AS DOUBLE) AS quantity) FROM top")
def top5_items_by_client(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.top_items(sales_view(spark, sf))


@query("top5_services_by_revenue", f"WITH {EVENT_SALES_SQL}, {top_sql('ev', 'count(*)', 'sum(cents)')} SELECT * REPLACE (CAST(quantity AS DOUBLE) AS quantity) FROM top")
def top5_services_by_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.top_items(event_sales(spark, sf, "servicos"))


@query("top5_share", f"""WITH {SALES_SQL}, {SV_TOP},
shares AS (SELECT client_id, rank, quantity,
   array_to_string(list_transform(string_split(item, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS item,
   CAST(quantity AS DOUBLE) / CAST(sum(quantity) OVER (PARTITION BY client_id) AS DOUBLE) * 100 AS pct,
   CAST(quantity AS DOUBLE) / CAST(max(quantity) OVER (PARTITION BY client_id) AS DOUBLE) AS ratio_to_max FROM top)
SELECT client_id, rank, item, CAST(quantity AS DOUBLE) AS quantity, CASE WHEN length(item) > 26 THEN item[1:24] || '...' ELSE item END AS short_name,
       format('{{:.1f}}', pct) || '% do Top 5' AS share,
       quantity || ' oc.' AS count_label, format('{{:.0f}}', pct) || '% do total' AS share_label, ratio_to_max FROM shares""")
def top5_share(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_rows(kpis.top_items(sales_view(spark, sf)))


@query("item_of_day", f"""WITH {EVENT_SALES_SQL}, today AS (SELECT * FROM ev WHERE day = (SELECT d FROM as_of)),
{top_sql('today', 'count(*)', 'count(*)', n=1)} SELECT client_id, item, CAST(quantity AS DOUBLE) AS quantity, amount FROM top""")
def item_of_day(spark: SparkSession, sf: str) -> DataFrame:
    events = event_sales(spark, sf)
    today = periods.filter_period(events, periods.TODAY, last_day(table(spark, sf, "events"), "ts"))
    return kpis.item_of_day(today)


_PERIOD_SQL = """WITH {ev} SELECT client_id, CAST(sum(cents) AS DOUBLE) AS total, count(*) AS transactions
FROM ev, as_of WHERE {where} GROUP BY client_id"""


def _period(spark: SparkSession, sf: str, period: str) -> DataFrame:
    rows = periods.filter_period(event_sales(spark, sf), period, last_day(table(spark, sf, "events"), "ts"))
    return kpis.totals(rows)


@query("period_today", _PERIOD_SQL.format(ev=EVENT_SALES_SQL, where="day = d"))
def period_today(spark: SparkSession, sf: str) -> DataFrame:
    return _period(spark, sf, periods.TODAY)


@query("period_week", _PERIOD_SQL.format(ev=EVENT_SALES_SQL, where="day >= date_trunc('week', d) AND day <= d"))
def period_week(spark: SparkSession, sf: str) -> DataFrame:
    return _period(spark, sf, periods.WEEK)


@query("period_month", _PERIOD_SQL.format(ev=EVENT_SALES_SQL, where="year(day) = year(d) AND month(day) = month(d)"))
def period_month(spark: SparkSession, sf: str) -> DataFrame:
    return _period(spark, sf, periods.MONTH)


@query("period_latest_year", f"""WITH {SALES_SQL},
years AS (SELECT client_id, max(year(sale_ts)) AS y FROM sv GROUP BY client_id)
SELECT sv.client_id, any_value(y) AS latest_year, CAST(coalesce(sum(cents) FILTER (year(sale_ts) = y), 0) AS DOUBLE) AS total,
       count(DISTINCT order_ref) FILTER (year(sale_ts) = y) AS transactions,
       count(*) FILTER (year(sale_ts) <> y) AS rows_outside_period
FROM sv JOIN years USING (client_id) GROUP BY sv.client_id""")
def period_latest_year(spark: SparkSession, sf: str) -> DataFrame:
    marked = periods.in_latest_year(sales_view(spark, sf, items=False))
    inside = F.col("in_period")
    return marked.groupBy("client_id").agg(
        F.max(F.year("sale_ts")).cast("long").alias("latest_year"),
        kpis.exact_sum(F.when(inside, F.col("amount"))).alias("total"),
        F.count_distinct(F.when(inside, F.col("order_ref"))).alias("transactions"),
        F.count(F.when(~inside, 1)).alias("rows_outside_period"),
    )


@query("vs_yesterday", f"WITH {EVENT_SALES_SQL}, pair AS (SELECT * FROM ev, as_of WHERE day IN (d, d - 1)), "
       f"{change_sql('pair', '(SELECT d FROM as_of)')} SELECT * FROM change")
def vs_yesterday(spark: SparkSession, sf: str) -> DataFrame:
    as_of = last_day(table(spark, sf, "events"), "ts")
    return kpis.vs_yesterday(periods.today_and_yesterday(event_sales(spark, sf), as_of), as_of)


@query("peak_hour", f"WITH {EVENT_SALES_SQL}, {peak_sql('ev')} SELECT * FROM peak")
def peak_hour(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.peak_hour(event_sales(spark, sf))


def quartiles_sql(source: str, keys: str, value: str = "amount", name: str = "quart") -> str:
    """Quartiles by rank with the same linear interpolation, spelled out."""
    def at(p: float) -> str:
        low = f"max(v) FILTER (r = CAST(floor((n - 1) * {p}) AS BIGINT))"
        high = f"max(v) FILTER (r = CAST(ceil((n - 1) * {p}) AS BIGINT))"
        part = f"(any_value(n) - 1) * {p}::DOUBLE - floor((any_value(n) - 1) * {p}::DOUBLE)"
        return (f"CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * ({part}) "
                f"ELSE {high} - ({high} - {low}) * (1 - ({part})) END")
    return f"""{name} AS (SELECT {keys}, any_value(n) AS total, max(v) AS top, {at(0.25)} AS q1, {at(0.75)} AS q3
  FROM (SELECT {keys}, CAST({value} AS DOUBLE) AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS r,
               count(*) OVER (PARTITION BY {keys}) AS n FROM {source}) GROUP BY {keys})"""


@query("quartiles_by_client", f"WITH {SALES_SQL}, {quartiles_sql('sv', 'client_id')} SELECT * FROM quart")
def quartiles_by_client(spark: SparkSession, sf: str) -> DataFrame:
    return quartiles(sales_view(spark, sf, items=False), ["client_id"])


@query("quartiles_by_line_status", f"""WITH src AS (SELECT l_linestatus AS line_status, l_extendedprice AS amount FROM lineitem),
{quartiles_sql('src', 'line_status')} SELECT * FROM quart""")
def quartiles_by_line_status(spark: SparkSession, sf: str) -> DataFrame:
    """Two groups that each hold half of all rows, by counting bins as for groups too large for one task."""
    lines = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("line_status"), F.col("l_extendedprice").alias("amount"))
    return quartiles(lines, ["line_status"])


# Sales cleaned by the fence, then the latest year of each client, as `kept`.
KEPT_SQL = f"""{SALES_SQL}, {quartiles_sql('sv', 'client_id')},
fenced AS (SELECT sv.* FROM sv JOIN quart USING (client_id)
  WHERE NOT (total >= 4 AND q3 > q1 AND amount > q3 + 3 * (q3 - q1))),
kept AS (SELECT * FROM fenced QUALIFY year(sale_ts) = max(year(sale_ts)) OVER (PARTITION BY client_id))"""


@query("kpi_full", f"""WITH {KEPT_SQL}, {CLIENTS_SQL}, {LATEST_SHIP_SQL}, {best_day_sql('kept')}, {peak_sql('kept')},
{change_sql('kept', '(SELECT d FROM last_ship)')},
{top_sql('kept', 'sum(CAST(quantity AS DECIMAL(18,2)))', 'sum(CAST(quantity AS DECIMAL(18,2)))', n=1)},
sums AS (SELECT client_id, CAST(sum(cents) AS DOUBLE) AS total, count(DISTINCT order_ref) AS transactions FROM kept GROUP BY client_id),
outside AS (SELECT client_id, count(*) AS n FROM fenced f
  WHERE year(sale_ts) < (SELECT max(year(sale_ts)) FROM fenced g WHERE g.client_id = f.client_id) GROUP BY client_id)
SELECT k AS client_id, coalesce(s.total, 0) AS total, coalesce(transactions, 0) AS transactions,
       coalesce(s.total / transactions, 0) AS avg_ticket,
       strftime(coalesce(best_day, (SELECT d FROM last_ship)), '%Y-%m-%d') AS best_day,
       strftime((SELECT d FROM last_ship), '%B') AS month_name, peak_hour, vs_yesterday_pct,
       top.item AS top_item, CAST(top.quantity AS DOUBLE) AS top_quantity, top.amount AS top_amount,
       coalesce(nullif(business_type, ''), 'retalho') AS business_type, coalesce(o.n, 0) AS rows_outside_period,
       CASE WHEN s.total IS NULL THEN 'no_valid_rows' ELSE 'ok' END AS status
FROM clients c LEFT JOIN sums s ON s.client_id = k LEFT JOIN best b ON b.client_id = k LEFT JOIN peak p ON p.client_id = k
LEFT JOIN change ch ON ch.client_id = k LEFT JOIN top ON top.client_id = k LEFT JOIN outside o ON o.client_id = k""")
def kpi_full(spark: SparkSession, sf: str) -> DataFrame:
    as_of = last_day(table(spark, sf, "lineitem"), "l_shipdate")
    clients = client_table(spark, sf).select(F.col("client_id").cast("long").alias("client_id"), "business_type")
    rows, _ = key_figures(sales_view(spark, sf), clients, as_of, daily=True)
    return rows.select(
        "client_id", "total", "transactions", "avg_ticket", _day("best_day"), "month_name", "peak_hour", "vs_yesterday_pct",
        F.col("item_of_day.item").alias("top_item"), F.col("item_of_day.quantity").alias("top_quantity"),
        F.col("item_of_day.amount").alias("top_amount"), "business_type", "rows_outside_period", "status",
    )


@query("empty_clients", f"""WITH {SALES_SQL}, {CLIENTS_SQL}, {LATEST_SHIP_SQL},
month AS (SELECT * FROM sv, last_ship WHERE year(sale_ts) = year(d) AND month(sale_ts) = month(d)), {best_day_sql('month')},
sums AS (SELECT client_id, CAST(sum(cents) AS DOUBLE) AS total, count(DISTINCT order_ref) AS transactions FROM month GROUP BY client_id),
known AS (SELECT DISTINCT client_id FROM sv)
SELECT k AS client_id, coalesce(total, 0) AS total, coalesce(transactions, 0) AS transactions, coalesce(total / transactions, 0) AS avg_ticket,
       strftime(coalesce(best_day, (SELECT d FROM last_ship)), '%Y-%m-%d') AS best_day,
       CASE WHEN kn.client_id IS NULL THEN 'no_valid_rows' WHEN total IS NULL THEN 'empty_period' ELSE 'no_item_column' END AS status
FROM clients LEFT JOIN sums s ON s.client_id = k LEFT JOIN best b ON b.client_id = k LEFT JOIN known kn ON kn.client_id = k""")
def empty_clients(spark: SparkSession, sf: str) -> DataFrame:
    as_of = last_day(table(spark, sf, "lineitem"), "l_shipdate")
    sales = sales_view(spark, sf, items=False)
    month = F.lit(True) & periods.between("sale_ts", *periods.period_range(periods.MONTH, as_of))
    facts = kpis.source_facts(sales.withColumn("reason", F.lit(None).cast("string")), month)
    rows = kpis.kpis(periods.filter_period(sales, periods.MONTH, as_of), as_of)
    clients = client_table(spark, sf).select(F.col("client_id").cast("long").alias("client_id"), "business_type")
    return kpis.complete(rows, facts, clients, as_of).select(
        "client_id", "total", "transactions", "avg_ticket", _day("best_day"), "status"
    )
