"""Queries on the client table, due reports and report texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.operators import client_ops, kpis, periods, report
from tillwork.plans.figure_queries import SV_TOP, best_day_sql, change_sql, peak_sql, top_sql
from tillwork.plans.registry import query
from tillwork.plans.views import CLIENTS_SQL, EVENT_SALES_SQL, SALES_SQL, client_table, event_sales, last_day, sales_view, table
from tillwork.sources import client_table as client_source
from tillwork.vocabulary import GOODS_LABELS, INSIGHT_NO_DATA, INSIGHT_PREFIX, SERVICE_LABELS

_DEFAULTS = "coalesce(nullif(business_type, ''), 'retalho') AS business_type, coalesce(nullif(cadence, ''), 'semanal') AS cadence"


def _label_sql(name: str) -> str:
    return f"CASE WHEN business_type = 'servicos' THEN '{SERVICE_LABELS[name]}' ELSE '{GOODS_LABELS[name]}' END"


@query("client_defaults", f"""WITH {CLIENTS_SQL}
SELECT client_id, name, {_DEFAULTS}, onboarding_step,
       CASE WHEN history = '["a","b"]' THEN 'a|b' ELSE '' END AS history FROM clients""")
def client_defaults(spark: SparkSession, sf: str) -> DataFrame:
    clients = client_source.with_defaults(client_table(spark, sf))
    return clients.select("client_id", "name", "business_type", "cadence", "onboarding_step", F.array_join("history", "|").alias("history"))


@query("client_lookup", f"""WITH {CLIENTS_SQL}, phones AS (SELECT o_orderkey, CAST(o_custkey + o_orderkey % 2 * 1000000000 AS VARCHAR) AS id FROM orders)
SELECT o_orderkey, id AS client_id, name, CASE WHEN c.client_id IS NOT NULL THEN coalesce(nullif(business_type, ''), 'retalho') END AS business_type
FROM phones LEFT JOIN clients c ON c.client_id = id""")
def client_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Phone numbers of orders, in two spellings, half of them unknown."""
    number = (F.col("o_custkey") + F.col("o_orderkey") % 2 * 1000000000).cast("string")
    spelled = F.when(F.col("o_orderkey") % 4 < 2, F.concat(F.lit(" +"), number, F.lit(" "))).otherwise(number)
    phones = table(spark, sf, "orders").select("o_orderkey", spelled.alias("phone"))
    found = client_source.lookup_many(client_table(spark, sf), phones)
    return found.select("o_orderkey", "client_id", "name", "business_type")


@query("client_insert_new", f"""WITH {CLIENTS_SQL}, phones AS (SELECT DISTINCT CAST(o_custkey * (1 + o_orderkey % 2) AS VARCHAR) AS id FROM orders)
SELECT client_id, name, cadence, onboarding_step, history FROM clients
UNION ALL SELECT id, NULL, 'semanal', 1, '[]' FROM phones WHERE id NOT IN (SELECT client_id FROM clients)""")
def client_insert_new(spark: SparkSession, sf: str) -> DataFrame:
    number = (F.col("o_custkey") * (1 + F.col("o_orderkey") % 2)).cast("string")
    phones = table(spark, sf, "orders").select(F.concat(F.lit("+"), number).alias("phone"))
    grown = client_ops.insert_new(client_table(spark, sf), phones, F.lit("2026-06-07 00:00:00"))
    return grown.select("client_id", "name", "cadence", "onboarding_step", "history")


@query("client_upsert", f"""WITH {CLIENTS_SQL}, updates AS (
  SELECT CAST(o_custkey AS VARCHAR) AS client_id, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'diario' WHEN 1 THEN 'mensal' END AS cadence,
         'report-' || o_orderkey AS last_report, o_orderkey % 2 = 0 AS sets_cadence FROM orders),
c AS (SELECT client_id, cadence FROM updates WHERE sets_cadence QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY k DESC) = 1),
r AS (SELECT client_id, last_report FROM updates WHERE NOT sets_cadence QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY k DESC) = 1)
SELECT client_id, name, CASE WHEN c.client_id IS NOT NULL THEN c.cadence ELSE clients.cadence END AS cadence, r.last_report
FROM clients LEFT JOIN c USING (client_id) LEFT JOIN r USING (client_id)""")
def client_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as updates: even ones set the cadence (sometimes to NULL), odd ones the report pointer."""
    key = F.col("o_orderkey")
    updates = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("client_id"), key.alias("k"),
        F.when(key % 2 == 0, F.array(F.lit("cadence"))).otherwise(F.array(F.lit("last_report"))).alias("changed"),
        F.when(key % 3 == 0, "diario").when(key % 3 == 1, "mensal").alias("cadence"),
        F.concat(F.lit("report-"), key.cast("string")).alias("last_report"),
    )
    changed = client_ops.update_fields(client_table(spark, sf), updates, ["cadence", "last_report"], ["k"])
    return changed.select("client_id", "name", "cadence", "last_report")


@query("latest_source", """SELECT CAST(o_custkey AS VARCHAR) AS client_id, o_orderkey AS source_id FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_source(spark: SparkSession, sf: str) -> DataFrame:
    uploads = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("client_id"), F.col("o_orderkey").alias("source_id"), F.col("o_orderdate").alias("uploaded_at")
    )
    return client_ops.latest_sources(uploads)


@query("sales_of_latest_source", """WITH newest AS (SELECT o_custkey AS client_id, o_orderkey FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT client_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS rows
FROM lineitem JOIN newest ON l_orderkey = o_orderkey GROUP BY client_id""")
def sales_of_latest_source(spark: SparkSession, sf: str) -> DataFrame:
    """Each order is a client's upload; only the newest one counts."""
    uploads = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("client_id"), F.col("o_orderkey").alias("source_id"), F.col("o_orderdate").alias("uploaded_at")
    )
    sales = sales_view(spark, sf, items=False).withColumn("source_id", F.col("order_ref"))
    newest = client_ops.sales_of_latest_sources(sales, uploads)
    return newest.groupBy("client_id").agg(kpis.exact_sum("amount").alias("total"), F.count("*").alias("rows"))


_RUN_SQL = "CAST('2026-05-31 00:00:00' AS TIMESTAMP) + to_minutes(k * 97)"


@query("due_clients", f"""WITH {CLIENTS_SQL}, runs AS (SELECT *, coalesce(cadence, 'semanal') AS cad, {_RUN_SQL} AS t FROM clients),
fires AS (SELECT *, CASE cad WHEN 'diario' THEN date_trunc('day', t) + INTERVAL 20 HOUR
   WHEN 'semanal' THEN date_trunc('week', t) + INTERVAL 8 HOUR WHEN 'mensal' THEN date_trunc('month', t) + INTERVAL 8 HOUR END AS fire FROM runs)
SELECT client_id, cad AS cadence, strftime(t, '%Y-%m-%d %H:%M') AS run_at FROM fires
WHERE onboarding_step = 0 AND t >= fire AND t <= fire + INTERVAL 1 HOUR""")
def due_clients(spark: SparkSession, sf: str) -> DataFrame:
    """Clients that are due, each at a run time of its own set by key."""
    run = F.lit("2026-05-31 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("client_id").cast("int") * 97))
    clients = client_ops.due(client_table(spark, sf).withColumn("run", run), F.col("run"))
    cadence = F.coalesce("cadence", F.lit("semanal")).alias("cadence")
    return clients.select("client_id", cadence, F.date_format("run", "yyyy-MM-dd HH:mm").alias("run_at"))


@query("reminders", f"""WITH {CLIENTS_SQL}
SELECT client_id, 'Ola ' || coalesce(name, 'Cliente') || '! Ainda nao recebi os teus dados. Envia o ficheiro para receberes o teu relatorio!' AS reminder
FROM clients WHERE onboarding_step = 0 AND coalesce(cadence, 'semanal') = 'semanal' AND last_file IS NULL""")
def reminders(spark: SparkSession, sf: str) -> DataFrame:
    clients = client_table(spark, sf)
    due = client_ops.of_cadence(client_ops.onboarded(clients), report.WEEKLY)
    return client_ops.reminders(due, client_ops.with_file(clients))


@query("clients_with_sales", f"""WITH {CLIENTS_SQL}, {SALES_SQL}
SELECT k AS client_id, any_value(last_file) AS last_file, coalesce(CAST(sum(cents) AS DOUBLE), 0) AS total
FROM clients LEFT JOIN sv ON sv.client_id = k WHERE onboarding_step = 0 AND coalesce(cadence, 'semanal') = 'mensal' GROUP BY k""")
def clients_with_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Onboarded monthly clients with their sales; sales are summed per client before the join."""
    clients = client_ops.of_cadence(client_ops.onboarded(client_table(spark, sf)), report.MONTHLY)
    totals = kpis.revenue(sales_view(spark, sf, items=False))
    chosen = clients.select(F.col("client_id").cast("long").alias("client_id"), "last_file")
    return chosen.join(totals, "client_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    clients = client_source.with_defaults(client_table(spark, sf))
    return clients.select(F.col("client_id").cast("long").alias("client_id"), "name", "business_type", "cadence")


def _figures(spark: SparkSession, sf: str, as_of: dt.date | None = None) -> DataFrame:
    """Key figures of all sales with business type and cadence; ``as_of`` gives the month's name."""
    return kpis.kpis(sales_view(spark, sf, items=False), as_of).join(_typed(spark, sf), "client_id")


_FIGURES_SQL = f"""{SALES_SQL}, {CLIENTS_SQL}, {best_day_sql('sv')},
typed AS (SELECT k AS client_id, name, {_DEFAULTS} FROM clients),
figures AS (SELECT client_id, CAST(sum(cents) AS DOUBLE) AS total, count(DISTINCT order_ref) AS transactions,
   CAST(sum(cents) AS DOUBLE) / count(DISTINCT order_ref) AS avg_ticket, any_value(best_day) AS best_day,
   any_value(business_type) AS business_type, any_value(cadence) AS cadence
  FROM sv JOIN best USING (client_id) JOIN typed USING (client_id) GROUP BY client_id)"""


@query("report_kpi_block", f"""WITH {_FIGURES_SQL}
SELECT client_id, 1 AS position, 'FATURACAO TOTAL' AS label, 'MZN ' || format('{{:,.2f}}', total) AS value FROM figures
UNION ALL SELECT client_id, 2, {_label_sql('items_sold')}, CAST(transactions AS VARCHAR) FROM figures
UNION ALL SELECT client_id, 3, {_label_sql('avg_ticket')}, 'MZN ' || format('{{:,.2f}}', avg_ticket) FROM figures
UNION ALL SELECT client_id, 4, 'MELHOR DIA', strftime(best_day, '%Y-%m-%d') FROM figures""")
def report_kpi_block(spark: SparkSession, sf: str) -> DataFrame:
    return report.kpi_block(_figures(spark, sf))


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    """Today's figures of event users, with type by key."""
    as_of = last_day(table(spark, sf, "events"), "ts")
    events = event_sales(spark, sf)
    kind = F.when(F.col("client_id") % 5 == 1, "servicos").otherwise("retalho")
    rows = kpis.kpis(
        periods.filter_period(events, periods.TODAY, as_of), as_of, daily=True, comparison=periods.today_and_yesterday(events, as_of)
    )
    return rows.withColumns({"business_type": kind, "cadence": F.lit(report.DAILY)})


_DAILY_SQL = f"""{EVENT_SALES_SQL}, today AS (SELECT ev.* FROM ev, as_of WHERE day = d), pair AS (SELECT ev.* FROM ev, as_of WHERE day IN (d, d - 1)),
{change_sql('pair', '(SELECT d FROM as_of)')}, {peak_sql('today')}, {top_sql('today', 'count(*)', 'count(*)', n=1)},
daily AS (SELECT t.client_id, CAST(sum(cents) AS DOUBLE) AS total, count(*) AS transactions, any_value(peak_hour) AS peak_hour,
   any_value(vs_yesterday_pct) AS pct, any_value(top.item) AS item, any_value(top.quantity) AS quantity, any_value(top.amount) AS item_amount,
   CASE WHEN t.client_id % 5 = 1 THEN 'servicos' ELSE 'retalho' END AS business_type
  FROM today t LEFT JOIN change USING (client_id) LEFT JOIN peak USING (client_id) LEFT JOIN top ON top.client_id = t.client_id GROUP BY t.client_id)"""


@query("daily_highlights", f"""WITH {_DAILY_SQL}
SELECT client_id, 1 AS position, {_label_sql('item_of_day')} AS label,
  upper(item[1]) || item[2:] || chr(10) || quantity || ' un . MZN ' || format('{{:,.2f}}', item_amount) AS value FROM daily
UNION ALL SELECT client_id, 2, 'HORA DE PICO', coalesce(peak_hour, '-') FROM daily
UNION ALL SELECT client_id, 3, 'VARIACAO VS ONTEM', coalesce(CASE WHEN pct >= 0 THEN '+ ' ELSE '- ' END || format('{{:.1f}}', abs(pct)) || '% vs ontem', '-') FROM daily""")
def daily_highlights(spark: SparkSession, sf: str) -> DataFrame:
    return report.highlights(_daily(spark, sf))


@query("daily_summary_text", f"""WITH {_DAILY_SQL}
SELECT client_id, concat_ws(chr(10), 'Resumo de hoje (' || strftime((SELECT d FROM as_of), '%d/%m/%Y') || '):',
  'Faturação: ' || format('{{:.2f}}', total) || ' MZN', {_label_sql('summary_items')} || ': ' || transactions,
  {_label_sql('summary_ticket')} || ': ' || format('{{:.2f}}', total / transactions) || ' MZN',
  {_label_sql('summary_item_of_day')} || ': ' || item || ' (' || quantity || ' un)', 'Hora de pico: ' || peak_hour,
  'Vs ontem: ' || CASE WHEN pct >= 0 THEN '+' ELSE '-' END || format('{{:.1f}}', abs(pct)) || '%') AS summary FROM daily""")
def daily_summary_text(spark: SparkSession, sf: str) -> DataFrame:
    return report.summary_text(_daily(spark, sf), last_day(table(spark, sf, "events"), "ts"))


@query("summary_text", f"""WITH {_FIGURES_SQL}
SELECT client_id, CASE WHEN cadence = 'mensal' THEN concat_ws(chr(10),
    'Resumo do Mês (' || strftime((SELECT max(l_shipdate) FROM lineitem), '%B') || '):', 'Faturação total: ' || format('{{:.2f}}', total) || ' MZN',
    'Transacções: ' || transactions, {_label_sql('summary_ticket')} || ': ' || format('{{:.2f}}', avg_ticket) || ' MZN', 'Melhor dia: ' || strftime(best_day, '%Y-%m-%d'))
  ELSE concat_ws(chr(10), 'Resumo da semana:', 'Faturação total: ' || format('{{:.2f}}', total) || ' MZN', {_label_sql('summary_items')} || ': ' || transactions,
    {_label_sql('summary_ticket')} || ': ' || format('{{:.2f}}', avg_ticket) || ' MZN', 'Melhor dia: ' || strftime(best_day, '%Y-%m-%d')) END AS summary
FROM figures WHERE cadence <> 'diario'""")
def summary_text(spark: SparkSession, sf: str) -> DataFrame:
    as_of = last_day(table(spark, sf, "lineitem"), "l_shipdate")
    return report.summary_text(_figures(spark, sf, as_of).filter(F.col("cadence") != report.DAILY), as_of)


@query("top5_text", f"""WITH {SALES_SQL}, {CLIENTS_SQL}, {SV_TOP}, typed AS (SELECT k AS client_id, {_DEFAULTS} FROM clients),
lines AS (SELECT client_id, string_agg(rank || '. ' || item || ' - ' || quantity || ' ocorrências', chr(10) ORDER BY rank) AS body FROM top GROUP BY client_id)
SELECT client_id, coalesce('Top 5 ' || {_label_sql('plural')} || ' (' || cadence || '):' || chr(10) || body,
  'Não foi possível identificar ' || {_label_sql('plural')} || ' no teu ficheiro.') AS top_text FROM typed LEFT JOIN lines USING (client_id)""")
def top5_text(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_text(_typed(spark, sf), kpis.top_items(sales_view(spark, sf)))


@query("insights", f"""WITH {SALES_SQL}, {CLIENTS_SQL}, {SV_TOP}, typed AS (SELECT k AS client_id, {_DEFAULTS} FROM clients)
SELECT t.client_id, '{INSIGHT_PREFIX}' || coalesce('O ' || {_label_sql('insight_item')} || ' ' || upper(item) || ' lidera o periodo em volume. '
  || {_label_sql('insight_action')}, '{INSIGHT_NO_DATA}') AS insight FROM typed t LEFT JOIN top ON top.client_id = t.client_id AND rank = 1""")
def insights(spark: SparkSession, sf: str) -> DataFrame:
    return report.insights(_typed(spark, sf), kpis.top_items(sales_view(spark, sf)))


@query("report_labels", f"""WITH {CLIENTS_SQL}, typed AS (SELECT k AS client_id, {_DEFAULTS} FROM clients)
SELECT client_id, {', '.join(f'{_label_sql(n)} AS {n}' for n in GOODS_LABELS)} FROM typed""")
def report_labels(spark: SparkSession, sf: str) -> DataFrame:
    return report.labels(_typed(spark, sf))


@query("period_labels", f"""WITH {CLIENTS_SQL}, {SALES_SQL}, as_of AS (SELECT max(sale_ts) AS d FROM sv),
typed AS (SELECT k AS client_id, coalesce(name, 'O meu negocio') AS name, {_DEFAULTS},
   CASE k % 10 WHEN 0 THEN 'report_' || k WHEN 5 THEN 'Primeira semana' END AS report_label FROM clients)
SELECT client_id, CASE WHEN cadence = 'diario' THEN 'Relatorio Diario - ' || strftime(d, '%d/%m/%Y')
  WHEN contains(report_label, '_') THEN 'Periodo Comercial ate ' || strftime(d, '%d/%m/%Y') WHEN report_label IS NOT NULL THEN report_label
  WHEN cadence = 'mensal' THEN 'Mes de ' || strftime(d, '%B') ELSE 'Semana Comercial ate ' || strftime(d, '%d/%m/%Y') END AS period_label,
  CASE WHEN contains(report_label, '_') THEN report_label ELSE replace(lower(name), ' ', '_') || '_estrategico' END AS report_name
FROM typed, as_of""")
def period_labels(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("client_id")
    own = F.when(key % 10 == 0, F.concat(F.lit("report_"), key.cast("string"))).when(key % 10 == 5, "Primeira semana")
    clients = _typed(spark, sf).withColumns({"report_label": own, "name": F.coalesce("name", F.lit("O meu negocio"))})
    return report.period_label(clients, last_day(table(spark, sf, "lineitem"), "l_shipdate"))
