"""Queries on chat messages and on streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.functions.messages import command, is_first_contact_greeting
from tillwork.operators import client_ops, folds
from tillwork.plans.figure_queries import quartiles_sql
from tillwork.plans.chat_reports import chat_figures as figures_of_chat
from tillwork.plans.registry import query
from tillwork.plans.views import CHAT_SQL, CLIENTS_SQL, EVENT_SALES_SQL, chat_messages, client_table, event_sales, table
from tillwork.staging import new_path
from tillwork.streaming import windows
from tillwork.streaming.fence import fence_in_batches, within_fence
from tillwork.streaming.folds import fold_in_batches, fold_in_order, sales_from_chat, waiting_effects
from tillwork.vocabulary import COMMANDS, FIRST_CONTACT_GREETINGS, SERVICE_TYPES, UNREAD_SALES, UNREAD_SERVICES

_AT = "yyyy-MM-dd HH:mm:ss"
_SECOND_DELIVERY = "2024-01-16 00:00:00"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_COMMAND_SQL = "CASE " + " ".join(f"WHEN w IN {_in(words)} THEN '{label}'" for label, words in COMMANDS.items()) + " ELSE 'help' END"

# One message at a time, as a state machine over (step, mode).
_MACHINE_SQL = f"""marked AS (SELECT *, trim(lower(text)) AS w FROM chat),
machine AS (
  SELECT client_id, message_id, n, text, w, {{step}} AS step0, NULL::VARCHAR AS name0, NULL::VARCHAR AS kind0, 'semanal' AS cadence0, '' AS mode0 FROM marked WHERE n = 1
  UNION ALL
  SELECT m.client_id, m.message_id, m.n, m.text, m.w,
    CASE WHEN step0 = 1 THEN CASE WHEN p.w IN {_in(FIRST_CONTACT_GREETINGS)} OR length(trim(p.text)) <= 2 THEN 1 ELSE 2 END
         WHEN step0 = 2 THEN 3 ELSE 0 END,
    CASE WHEN step0 = 1 AND NOT (p.w IN {_in(FIRST_CONTACT_GREETINGS)} OR length(trim(p.text)) <= 2) THEN trim(p.text) ELSE name0 END,
    CASE WHEN step0 = 2 THEN CASE p.w WHEN '1' THEN 'servicos' WHEN '2' THEN 'retalho' WHEN '3' THEN 'agropecuaria' WHEN '4' THEN 'outro' ELSE p.w END ELSE kind0 END,
    CASE WHEN step0 = 3 OR (step0 = 0 AND mode0 = 'aguardar_frequencia') THEN
      CASE p.w WHEN '1' THEN 'diario' WHEN '2' THEN 'semanal' WHEN '3' THEN 'mensal' ELSE CASE WHEN step0 = 3 THEN 'semanal' ELSE cadence0 END END ELSE cadence0 END,
    CASE WHEN step0 > 0 THEN '' WHEN mode0 = 'aguardar_vendas' THEN ''
         WHEN mode0 = 'aguardar_frequencia' THEN CASE WHEN p.w IN ('cancelar', '1', '2', '3') THEN '' ELSE mode0 END
         WHEN p.w IN {_in(COMMANDS['sales'])} THEN 'aguardar_vendas' WHEN p.w IN {_in(COMMANDS['cadence'])} THEN 'aguardar_frequencia' ELSE '' END
  FROM machine p JOIN marked m ON m.client_id = p.client_id AND m.n = p.n + 1),
acted AS (SELECT *, CASE WHEN step0 = 1 THEN CASE WHEN w IN {_in(FIRST_CONTACT_GREETINGS)} OR length(trim(text)) <= 2 THEN 'ask_name' ELSE 'set_name' END
  WHEN step0 = 2 THEN 'set_business_type' WHEN step0 = 3 THEN 'set_cadence'
  WHEN mode0 = 'aguardar_vendas' THEN CASE WHEN w = 'cancelar' THEN 'cancel' ELSE 'sales_text' END
  WHEN mode0 = 'aguardar_frequencia' THEN CASE WHEN w = 'cancelar' THEN 'cancel' WHEN w IN ('1', '2', '3') THEN 'set_cadence' ELSE 'invalid_option' END
  ELSE {_COMMAND_SQL} END AS action FROM machine)"""


@query("classify_command", f"""WITH {CHAT_SQL}, marked AS (SELECT *, trim(lower(text)) AS w FROM chat)
SELECT message_id, {_COMMAND_SQL} AS command, w IN {_in(FIRST_CONTACT_GREETINGS)} OR length(w) <= 2 AS is_greeting FROM marked
UNION ALL SELECT conv_id || '/' || turn, 'help', false FROM conversations""")
def classify_command(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    prose = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("message_id"), "text")
    messages = chat_messages(spark, sf).select("message_id", "text").unionByName(prose)
    return messages.select("message_id", command(text).alias("command"), is_first_contact_greeting(text).alias("is_greeting"))


@query("refused_documents", f"""WITH {CLIENTS_SQL}
SELECT o_orderkey AS message_id, o.id AS client_id, onboarding_step
FROM (SELECT o_orderkey, CAST(o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000000 ELSE 0 END AS VARCHAR) AS id FROM orders WHERE o_orderkey % 2 = 0) o
LEFT JOIN clients c ON c.client_id = o.id WHERE c.client_id IS NULL OR onboarding_step > 0""")
def refused_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as messages: even ones are documents, every fifth from an unknown number."""
    key = F.col("o_orderkey")
    messages = table(spark, sf, "orders").select(
        key.alias("message_id"), (F.col("o_custkey") + F.when(key % 5 == 0, 1000000000).otherwise(0)).cast("string").alias("client_id"),
        F.when(key % 2 == 0, "document").otherwise("text").alias("type"),
    )
    return client_ops.refused_documents(messages, client_table(spark, sf)).select("message_id", "client_id", "onboarding_step")


def _repeated(events: DataFrame) -> DataFrame:
    """Events as messages; every third arrives three times."""
    messages = events.select(
        F.when(F.col("event_id") % 50 != 0, F.format_string("m%d", F.col("event_id"))).otherwise(F.lit("")).alias("message_id"),
        F.col("user_id").cast("string").alias("client_id"), F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_id").alias("k"),
    )
    copies = F.when(F.col("k") % 3 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    late = messages.withColumn("copy", F.explode(copies))
    return late.withColumn("event_ts", F.col("event_ts") + F.make_dt_interval(secs=F.col("copy").cast("decimal(18,6)"))).drop("copy")


@query("dedup_events", """SELECT CASE WHEN event_id % 50 <> 0 THEN 'm' || event_id ELSE '' END AS message_id, CAST(user_id AS VARCHAR) AS client_id,
  strftime(ts + to_seconds(CASE WHEN event_id % 50 = 0 THEN c ELSE 0 END), '%Y-%m-%d %H:%M:%S') AS at
FROM events, (SELECT unnest([0, 1, 2]) AS c)
WHERE (c = 0 OR (event_id % 3 = 0 AND event_id % 50 = 0)) AND (event_id % 50 = 0 OR event_id % 7 <> 0)""")
def dedup_events(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated messages once, less the ones already seen (every seventh)."""
    events = table(spark, sf, "events")
    seen = events.filter("event_id % 7 = 0").select(F.format_string("m%d", F.col("event_id")).alias("message_id"))
    fresh = client_ops.not_seen(_repeated(events), seen)
    return fresh.select("message_id", "client_id", F.date_format("event_ts", _AT).alias("at"))


@query("mark_seen", """SELECT 'm' || event_id AS message_id FROM events WHERE event_id % 50 <> 0 OR event_id % 7 = 0""")
def mark_seen(spark: SparkSession, sf: str) -> DataFrame:
    """The seen table after a batch: old ids stay, new ones are added once."""
    events = table(spark, sf, "events")
    now = F.lit("2026-06-07 00:00:00")
    seen = events.filter("event_id % 7 = 0").select(
        F.format_string("m%d", F.col("event_id")).alias("message_id"), now.cast("timestamp_ntz").alias("created_at")
    )
    return client_ops.mark_seen(seen, _repeated(events), now).select("message_id")


@query("profile_fold", f"""WITH RECURSIVE {CHAT_SQL}, {_MACHINE_SQL.format(step=1)},
last AS (SELECT * FROM acted QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY (step0 = 0), n DESC) = 1),
named AS (SELECT client_id, min(n) FILTER (action = 'set_name') AS n1 FROM acted WHERE step0 > 0 GROUP BY client_id)
SELECT a.client_id, any_value(trim(text)) FILTER (n = n1) AS name,
  any_value(CASE w WHEN '1' THEN 'servicos' WHEN '2' THEN 'retalho' WHEN '3' THEN 'agropecuaria' WHEN '4' THEN 'outro' ELSE w END) FILTER (n = n1 + 1) AS business_type,
  any_value(CASE w WHEN '1' THEN 'diario' WHEN '3' THEN 'mensal' ELSE 'semanal' END) FILTER (n = n1 + 2) AS cadence,
  CASE WHEN any_value(n1) IS NULL THEN 1 WHEN max(n) = any_value(n1) THEN 2 WHEN max(n) = any_value(n1) + 1 THEN 3 ELSE 0 END AS onboarding_step
FROM acted a JOIN named USING (client_id) GROUP BY a.client_id""")
def profile_fold(spark: SparkSession, sf: str) -> DataFrame:
    return folds.profile_fold(chat_messages(spark, sf))


@query("mode_fold", f"""WITH RECURSIVE {CHAT_SQL}, {_MACHINE_SQL.format(step=0)}
SELECT client_id, message_id, mode0 AS mode, action,
  CASE WHEN action = 'set_cadence' THEN CASE w WHEN '1' THEN 'diario' WHEN '2' THEN 'semanal' ELSE 'mensal' END END AS new_cadence FROM acted""")
def mode_fold(spark: SparkSession, sf: str) -> DataFrame:
    modes = folds.mode_fold(chat_messages(spark, sf), block=F.date_trunc("day", "event_ts"))
    return modes.select("client_id", "message_id", "mode", "action", "new_cadence")


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    file = f"{name}.parquet"
    schema = spark.read.parquet(f"{sf}/{file}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(sf)


def _run(changes: DataFrame, spark: SparkSession, name: str, keys: list[str]) -> DataFrame:
    """Run a stream to its end in update mode and read the newest row per key."""
    path = new_path(spark, name)
    running = windows.write_updates(changes, path, f"{path}-checkpoint", keys).trigger(availableNow=True).start()
    running.awaitTermination()
    return windows.latest_updates(spark, path, keys)


def _deliver(rows: DataFrame, path: str) -> None:
    """Add rows to the folder that a stream reads."""
    rows.write.mode("append").parquet(f"{path}/in")


@query("dedup_stream", """SELECT CASE WHEN event_id % 50 <> 0 THEN 'm' || event_id ELSE '' END AS message_id, CAST(user_id AS VARCHAR) AS client_id
FROM events, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS c) WHERE c = 0 OR (event_id % 50 = 0 AND (c = 3 OR event_id % 3 = 0))""")
def dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All messages, then those of even events again 40 days later: of these only the ones without an id pass."""
    events = table(spark, sf, "events")
    again = events.filter("event_id % 2 = 0").withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(40)))
    path = new_path(spark, "dedup")
    for part in (_repeated(events).drop("k"), _repeated(again).drop("k")):
        _deliver(part, path)
        messages = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        windows.dedup_in_batches(messages, path, f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/fresh").select("message_id", "client_id")


@query("rate_windows", """SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests,
  count(*) > 5 AS over_limit FROM events GROUP BY ALL""")
def rate_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events per type and hour against a limit of five."""
    rates = windows.rate_windows(_stream(spark, sf, "events"), "1 hour", 5, ["event_type"], "ts")
    newest = _run(rates, spark, "rates", ["event_type", "window_start"])
    return newest.withColumn("window_start", F.date_format("window_start", _AT))


@query("stream_fence", f"""WITH {EVENT_SALES_SQL}, {quartiles_sql('ev', 'client_id')}
SELECT client_id, event_id, amount FROM ev JOIN quart USING (client_id) WHERE NOT (total >= 4 AND q3 > q1 AND amount > q3 + 3 * (q3 - q1))""")
def stream_fence(spark: SparkSession, sf: str) -> DataFrame:
    """The outlier fence of event users' sales, which arrive in three deliveries."""
    sales, path = event_sales(spark, sf).select("client_id", "source_id", "row_ix", "amount"), new_path(spark, "fence")
    for i in range(3):
        _deliver(sales.filter(F.col("row_ix") % 3 == i), path)
        feed = spark.readStream.schema(sales.schema).parquet(f"{path}/in")
        fence_in_batches(feed, path, f"{path}/checkpoint", 8).trigger(availableNow=True).start().awaitTermination()
    return within_fence(spark, path).select("client_id", F.col("row_ix").alias("event_id"), "amount")


@query("running_kpis", """SELECT user_id AS client_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
  count(*) AS transactions FROM events GROUP BY ALL""")
def running_kpis(spark: SparkSession, sf: str) -> DataFrame:
    sales = _stream(spark, sf, "events").select(F.col("user_id").alias("client_id"), F.col("ts").alias("sale_ts"), F.col("value").alias("amount"))
    newest = _run(windows.running_kpis(sales), spark, "running", ["client_id", "day"])
    return newest.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _fold_chat(spark: SparkSession, *parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with their effect, profiles), folded by a stream that is started once for each part of the history."""
    path = new_path(spark, "chat")
    for part in parts:
        _deliver(part, path)
        messages = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        fold_in_batches(messages, path, f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/actions"), windows.latest_updates(spark, f"{path}/profiles", ["client_id"])


@query("chat_stream", f"""WITH RECURSIVE {CHAT_SQL}, {_MACHINE_SQL.format(step=1)} SELECT client_id, message_id, action FROM acted""")
def chat_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Registration and chat modes as one batch job per micro-batch, with profiles kept in a table."""
    return _fold_chat(spark, chat_messages(spark, sf))[0].select("client_id", "message_id", "action")


@query("chat_batches", f"""WITH RECURSIVE {CHAT_SQL}, {_MACHINE_SQL.format(step=1)} SELECT client_id, message_id, action FROM acted""")
def chat_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same history in two deliveries, the second on top of the profiles that the first left."""
    messages = chat_messages(spark, sf)
    later = F.col("event_ts") >= F.lit(_SECOND_DELIVERY).cast("timestamp")
    return _fold_chat(spark, messages.filter(~later), messages.filter(later))[0].select("client_id", "message_id", "action")


@query("chat_in_order", f"""WITH RECURSIVE {CHAT_SQL}, {_MACHINE_SQL.format(step=1)} SELECT client_id, message_id, action FROM acted""")
def chat_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The same history arriving up to twelve hours late in three deliveries, folded in the order of event time."""
    messages = chat_messages(spark, sf)
    arrival = F.col("event_ts") + F.make_dt_interval(mins=F.pmod(F.xxhash64("message_id"), F.lit(720)).cast("int"))
    part = F.when(arrival < F.lit("2024-01-11").cast("timestamp"), 0).when(arrival < F.lit("2024-01-21").cast("timestamp"), 1).otherwise(2)
    path = new_path(spark, "chat")
    for i in range(3):
        _deliver(messages.filter(part == i), path)
        feed = spark.readStream.schema(messages.schema).parquet(f"{path}/in")
        fold_in_order(feed, path, f"{path}/checkpoint", dt.timedelta(days=1)).trigger(availableNow=True).start().awaitTermination()
    columns = ["client_id", "message_id", "action"]
    return spark.read.parquet(f"{path}/actions").select(*columns).unionByName(waiting_effects(spark, path)[0].select(*columns))


@query("chat_sales", f"""WITH RECURSIVE {CHAT_SQL}, {_MACHINE_SQL.format(step=1)}
SELECT client_id, message_id AS source_id, 'Frango' AS item, 2.0::DOUBLE AS quantity, 30.0::DOUBLE AS amount FROM acted
WHERE action = 'sales_text' AND text = 'Frango, 2, 30'""")
def chat_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales rows out of the messages that the stream read in sales mode."""
    actions, profiles = _fold_chat(spark, chat_messages(spark, sf))
    told = actions.filter("action = 'sales_text'").join(profiles.select("client_id", "business_type"), "client_id", "left")
    return sales_from_chat(told).select("client_id", "source_id", "item", "quantity", "amount")


@query("chat_figures", f"""WITH RECURSIVE {CHAT_SQL}, {_MACHINE_SQL.format(step=1)},
told AS (SELECT a.client_id, a.message_id AS source_id, kind0, strftime(event_ts, '%Y-%m-%d') AS best_day, a.text = 'Frango, 2, 30' AS read
  FROM acted a JOIN chat USING (client_id, message_id) WHERE action = 'sales_text')
SELECT client_id, source_id, CASE WHEN read THEN 30.0 ELSE 0.0 END AS total, CASE WHEN read THEN 1 ELSE 0 END AS transactions,
  CASE WHEN read THEN 30.0 ELSE 0.0 END AS avg_ticket, best_day, CASE WHEN read THEN 'Frango' END AS top_item, CASE WHEN read THEN 2.0 END AS top_quantity,
  CASE WHEN read THEN 'ok' ELSE 'unreadable' END AS status,
  CASE WHEN NOT read THEN CASE WHEN kind0 IN {_in(SERVICE_TYPES)} THEN '{UNREAD_SERVICES}' ELSE '{UNREAD_SALES}' END END AS reply FROM told""")
def chat_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of every message that the stream read in sales mode, or the reply to one that cannot be read."""
    actions, profiles = _fold_chat(spark, chat_messages(spark, sf))
    rows, _ = figures_of_chat(actions.join(profiles.select("client_id", "business_type"), "client_id", "left"))
    item = F.col("item_of_day")
    return rows.select(
        "client_id", "source_id", "total", "transactions", "avg_ticket", F.date_format("best_day", "yyyy-MM-dd").alias("best_day"),
        item["item"].alias("top_item"), item["quantity"].alias("top_quantity"), "status", "reply",
    )
