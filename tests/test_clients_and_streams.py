import datetime as dt
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tillwork import staging
from tillwork.operators import client_ops, folds
from tillwork.plans import chat_reports
from tillwork.schemas import CLIENTS, SEEN_MESSAGES
from tillwork.sources import client_table, events
from tillwork.sources.text_sales import text_lines, text_sales
from tillwork.streaming import folds as stream_folds
from tillwork.streaming import windows
from tillwork.streaming.seen import SeenIds
from tillwork.vocabulary import (
    BUSINESS_TYPE_CODES,
    CADENCE_CODES,
    CANCEL,
    COMMANDS,
    DEFAULT_BUSINESS_TYPE,
    DEFAULT_CADENCE,
    FIRST_CONTACT_GREETINGS,
    MODE_CADENCE,
    MODE_SALES,
)

START = dt.datetime(2026, 6, 1)

# The registration and chat rules, one message at a time.
NEW = (1, None, None, DEFAULT_CADENCE, None)


def next_profile(state: tuple, text: str) -> tuple[tuple, str]:
    """State after one message, and what the message did."""
    step, name, kind, cadence, mode = state
    answer = text.strip()
    word = answer.lower()
    if step == 1:
        if word in FIRST_CONTACT_GREETINGS or len(answer) <= 2:
            return state, "ask_name"
        return (2, answer, kind, cadence, mode), "set_name"
    if step == 2:
        kind = BUSINESS_TYPE_CODES.get(answer, word or DEFAULT_BUSINESS_TYPE)
        return (3, name, kind, cadence, mode), "set_business_type"
    if step == 3:
        return (0, name, kind, CADENCE_CODES.get(answer, DEFAULT_CADENCE), mode), "set_cadence"
    if mode == MODE_SALES:
        return (step, name, kind, cadence, None), "cancel" if word == CANCEL else "sales_text"
    if mode == MODE_CADENCE:
        if word == CANCEL:
            return (step, name, kind, cadence, None), "cancel"
        if answer in CADENCE_CODES:
            return (step, name, kind, CADENCE_CODES[answer], None), "set_cadence"
        return state, "invalid_option"
    action = next((label for label, words in COMMANDS.items() if word in words), "help")
    opened = {"sales": MODE_SALES, "cadence": MODE_CADENCE}.get(action)
    return (step, name, kind, cadence, opened), action


@pytest.fixture
def clients(spark):
    rows = [
        ("1", "Azul", "servicos", "diario", "u/1.csv", None, 0, '["a"]', None, START), ("2", None, None, None, None, None, 0, None, "aguardar_vendas", START),
        ("3", "Mar", "", "mensal", "", None, 2, "", None, START),
    ]
    return spark.createDataFrame(rows, CLIENTS)


def test_defaults_and_lookup(spark, clients):
    got = {r.client_id: (r.business_type, r.cadence, r.history) for r in client_table.with_defaults(clients).collect()}
    assert got == {"1": ("servicos", "diario", ["a"]), "2": ("retalho", "semanal", []), "3": ("retalho", "mensal", [])}
    assert client_table.lookup(clients, " +1 ").first().name == "Azul"
    phones = spark.createDataFrame([("+2",), ("9",)], "phone string")
    assert {(r.client_id, r.cadence) for r in client_table.lookup_many(clients, phones).collect()} == {("2", "semanal"), ("9", None)}


def test_insert_and_update(spark, clients):
    phones = spark.createDataFrame([("+1",), ("7",), ("+7",)], "phone string")
    grown = client_ops.insert_new(clients, phones, F.lit(START))
    assert {r.client_id: (r.cadence, r.onboarding_step, r.history) for r in grown.collect()}["7"] == ("semanal", 1, "[]") and grown.count() == 4
    updates = spark.createDataFrame(
        [("2", 1, ["mode"], None, None), ("2", 2, ["cadence"], "x", "diario"), ("1", 1, ["mode"], "a", None), ("1", 3, ["mode"], "b", None), ("1", 2, ["mode"], "c", None), ("8", 1, ["mode"], "z", None)],
        "client_id string, at int, changed array<string>, mode string, cadence string",
    )
    got = {r.client_id: (r["mode"], r.cadence) for r in client_ops.update_fields(clients, updates, ["mode", "cadence"], ["at"]).collect()}
    assert got == {"1": ("b", "diario"), "2": (None, "diario"), "3": (None, "mensal")}


@pytest.mark.parametrize("at,due", [
    (dt.datetime(2026, 6, 8, 8, 30), {"semanal"}), (dt.datetime(2026, 6, 1, 8, 30), {"semanal", "mensal"}), (dt.datetime(2026, 7, 1, 8, 0), {"mensal"}),
    (dt.datetime(2026, 7, 1, 9, 0), {"mensal"}), (dt.datetime(2026, 7, 1, 9, 0, 1), set()), (dt.datetime(2026, 6, 3, 20, 59), {"diario"}),
    (dt.datetime(2026, 6, 3, 21, 1), set()), (dt.datetime(2026, 6, 3, 19, 59, 59), set()), (dt.datetime(2026, 6, 2, 8, 30), set()),
])
def test_due_times(spark, at, due):
    df = spark.createDataFrame([(c, 0) for c in ("diario", "semanal", "mensal")] + [("diario", 1)], "cadence string, onboarding_step int")
    assert {r.cadence for r in client_ops.due(df, at).collect()} == due


def test_reminders(clients):
    texts = client_ops.reminders(client_ops.onboarded(clients), client_ops.with_file(clients)).collect()
    assert [(r.client_id, r.reminder.split("!")[0]) for r in texts] == [("2", "Ola Cliente")]


def test_latest_source(spark, sales):
    uploads = spark.createDataFrame([("a", "s1", 1), ("a", "s2", 3), ("a", "s3", 3), ("b", "s4", 1)], "client_id string, source_id string, uploaded_at int")
    assert {(r.client_id, r.source_id) for r in client_ops.latest_sources(uploads).collect()} == {("a", "s3"), ("b", "s4")}
    df = sales({"client_id": "a", "source_id": "s1"}, {"client_id": "a", "source_id": "s3"}, {"client_id": "b", "source_id": "s4"})
    assert {r.source_id for r in client_ops.sales_of_latest_sources(df, uploads).collect()} == {"s3", "s4"}


def body(*messages, **value):
    return json.dumps({"entry": [{"changes": [{"value": {"messages": list(messages), **value}}]}]})


def test_event_extract(spark):
    text = {"id": "m1", "from": "+2588", "type": "text", "text": {"body": "oi"}}
    doc = {"id": "m2", "from": "2588", "type": "document", "document": {"id": "d", "filename": "v.csv"}}
    unnamed = {"from": "1", "type": "document", "document": {"id": "e"}}
    bodies = [body(text, doc), body(unnamed), json.dumps({"entry": [{"changes": [{"value": {"statuses": []}}]}]}), "{broken", '{"entry": []}', "[]", None, '"x"']
    df = spark.createDataFrame([(b, START) for b in bodies], "body string, event_ts timestamp")
    rows = events.extract_messages(df).collect()
    assert {(r.message_id, r.client_id, r.type, r.text, r.document_id) for r in rows} == {
        ("m1", "2588", "text", "oi", None), ("m2", "2588", "document", None, "d"), ("", "1", "document", None, "e"),
    }
    names = {r.message_id: r.filename for r in rows}
    assert names["m1"] is None and names["m2"] == "v.csv"
    assert re.fullmatch(r"vendas_\d+\.xlsx", names[""])
    first = events.extract_messages(df, first_only=True)
    assert {r.message_id for r in first.collect()} == {"m1", ""}
    assert events.text_messages(first).count() == 1 and events.document_messages(first).count() == 1


def test_documents_of_unregistered_clients(spark, clients):
    rows = [("m1", "1", "document", "d"), ("m2", "3", "document", "d"), ("m3", "9", "document", "d"), ("m4", "3", "text", None), ("m5", "1", "document", None)]
    messages = spark.createDataFrame(rows, "message_id string, client_id string, type string, document_id string")
    assert {r.message_id for r in client_ops.refused_documents(messages, clients).collect()} == {"m2", "m3"}
    assert {r.message_id for r in client_ops.accepted_documents(messages, clients).collect()} == {"m1"}


def test_text_sales(spark):
    text = "\n".join(["Frango, 3, 250", "produto, quantidade, valor", "Arroz, 2,5, 80", "Feijao, 2", "", "X, nan, 5", "Y, 1_000, 5", " Sumo ,1.5,  2e1 "])
    df = spark.createDataFrame([("c", "s", "retalho", text, START)], "client_id string, source_id string, business_type string, text string, received_at timestamp")
    got = [(r.item, r.quantity, r.amount, r.sale_ts) for r in text_sales(df, dt.date(2026, 6, 7)).orderBy("row_ix").collect()]
    assert got == [("Frango", 3.0, 250.0, dt.datetime(2026, 6, 7)), ("Sumo", 1.5, 20.0, dt.datetime(2026, 6, 7))]
    reasons = {r.line_no: r.reason for r in text_lines(df).filter("reason is not null").collect()}
    assert reasons == {1: "not_numeric", 2: "not_three_fields", 3: "not_three_fields", 5: "not_numeric", 6: "not_numeric"}
    assert text_sales(df).first().sale_ts == dt.datetime(2026, 6, 1)


def test_seen_messages(spark):
    seen = spark.createDataFrame([("m1", START)], SEEN_MESSAGES)
    rows = [("m1", "a", 1), ("m2", "a", 3), ("m2", "b", 2), ("", "a", 1), ("", "a", 1), (None, "c", 1)]
    messages = spark.createDataFrame(rows, "message_id string, client_id string, event_ts int")
    fresh = [(r.message_id, r.client_id) for r in client_ops.not_seen(messages, seen).collect()]
    assert sorted(fresh, key=str) == sorted([("m2", "b"), ("", "a"), ("", "a"), (None, "c")], key=str)
    assert sorted(r.message_id for r in client_ops.mark_seen(seen, messages, F.lit(START)).collect()) == ["m1", "m2"]


WORDS = ["5", "6", "1", "2", "3", "cancelar", "ola", "Loja Azul", "4", "vendas", "Frango, 2, 30", ""]


@pytest.fixture(scope="module")
def chat(spark):
    rng = random.Random(11)
    rows = []
    for c in range(25):
        for i in range(rng.randint(1, 50)):
            rows.append((f"c{c}", f"m{c:02d}{i:03d}", START + dt.timedelta(minutes=11 * i), rng.choice(WORDS)))
    return spark.createDataFrame(rows, "client_id string, message_id string, event_ts timestamp, text string")


def by_client(chat):
    histories = {}
    for r in sorted(chat.collect(), key=lambda r: (r.event_ts, r.message_id)):
        histories.setdefault(r.client_id, []).append(r)
    return histories


def test_registration_script():
    state, actions = NEW, []
    for text in ["oi", "Loja Azul", "1", "3"]:
        state, action = next_profile(state, text)
        actions.append(action)
    assert actions == ["ask_name", "set_name", "set_business_type", "set_cadence"] and state == (0, "Loja Azul", "servicos", "mensal", None)


def test_profile_fold_equals_message_by_message(chat):
    expected = {}
    for client, messages in by_client(chat).items():
        state = NEW
        for m in messages:
            if state[0] != 0:
                state, _ = next_profile(state, m.text)
        expected[client] = (state[1], state[2], state[3] if state[0] == 0 else None, state[0])
    got = {r.client_id: (r.name, r.business_type, r.cadence, r.onboarding_step) for r in folds.profile_fold(chat).collect()}
    assert got == expected


@pytest.mark.parametrize("block", [None, "hour", "day", "year"])
def test_mode_fold_equals_message_by_message(chat, block):
    expected = {}
    for messages in by_client(chat).values():
        state = (0, "n", "retalho", "semanal", None)
        for m in messages:
            mode = state[4] or ""
            state, action = next_profile(state, m.text)
            expected[m.message_id] = (mode, action)
    got = {r.message_id: (r.mode, r.action) for r in folds.mode_fold(chat, block=block and F.date_trunc(block, "event_ts")).collect()}
    assert got == expected


def test_mode_fold_of_a_burst_without_times(spark):
    """One client's 3000 messages of one second, and as many without a time, are cut into several blocks."""
    words = F.array(*[F.lit(w) for w in ["5", "6", "x", "1", "5", "cancelar"]])
    rows = spark.range(6000).select(
        F.lit("c").alias("client_id"), F.format_string("m%06d", "id").alias("message_id"),
        F.when(F.col("id") >= 3000, F.timestamp_seconds(F.lit(60))).alias("event_ts"), F.get(words, (F.abs(F.xxhash64("id")) % 6).cast("int")).alias("text"),
    )
    got = {r.message_id: (r.mode, r.action) for r in folds.mode_fold(rows).collect()}
    state, expected = (0, "n", "retalho", "semanal", None), {}
    for m in sorted(rows.collect(), key=lambda r: r.message_id):
        mode = state[4] or ""
        state, action = next_profile(state, m.text)
        expected[m.message_id] = (mode, action)
    assert got == expected
    ranges = rows.repartitionByRange(8, "client_id", "event_ts", "message_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) < 1500


def test_chat_figures(spark):
    at = dt.datetime(2026, 6, 7, 9)
    told = spark.createDataFrame([
        ("c", "m1", at, "Frango, 2, 30\nPeixe, 1, 50\nFrango, 1, 15\nlixo", "sales_text", "retalho"), ("c", "m2", at, "Frango, 0, 30", "sales_text", "retalho"),
        ("c", "m3", at, "vendi muito", "sales_text", "retalho"), ("s", "m4", at, "", "sales_text", "servicos"), ("s", "m5", at, "Corte, 1, 9", "help", "servicos"),
    ], "client_id string, message_id string, event_ts timestamp, text string, action string, business_type string")
    rows, top = chat_reports.chat_figures(told)
    got = {r.source_id: r for r in rows.collect()}
    assert {k: (r.total, r.transactions, r.status) for k, r in got.items()} == {
        "m1": (95.0, 3, "ok"), "m2": (0.0, 0, "no_valid_rows"), "m3": (0.0, 0, "unreadable"), "m4": (0.0, 0, "unreadable"),
    }
    assert got["m1"].best_day == at.date() and got["m1"].reply is None and got["m2"].reply is None
    assert "Frango, 3, 250" in got["m3"].reply and "Consultoria" in got["m4"].reply
    assert [(r.source_id, r.item, r.quantity) for r in top.orderBy("source_id", "rank").collect()] == [("m1", "Frango", 3.0), ("m1", "Peixe", 1.0)]
    none, _ = chat_reports.chat_figures(told.filter("false"))
    assert none.count() == 0


@pytest.mark.parametrize("begin", ["", "aguardar_vendas", "aguardar_frequencia"])
def test_mode_fold_of_one_client_in_many_blocks(spark, begin):
    """A third of the words change modes, every message is a block of its own, and ten have no time."""
    words = F.array(*[F.lit(w) for w in ["5", "6", "5", "x", "1", "5", "y", "cancelar", "6", "5"]])
    rows = spark.range(20_000).select(
        F.lit("c").alias("client_id"), F.format_string("m%06d", "id").alias("message_id"),
        F.when(F.col("id") >= 10, F.timestamp_seconds(F.col("id") * 60)).alias("event_ts"),
        F.get(words, (F.abs(F.xxhash64("id")) % 10).cast("int")).alias("text"),
    )
    initial = spark.createDataFrame([("c", begin)], "client_id string, mode string")
    got = {r.message_id: (r.mode, r.action) for r in folds.mode_fold(rows, initial=initial).collect()}
    state, expected = (0, "n", "retalho", "semanal", begin or None), {}
    for m in sorted(rows.collect(), key=lambda r: r.message_id):
        mode = state[4] or ""
        state, action = next_profile(state, m.text)
        expected[m.message_id] = (mode, action)
    assert got == expected


def stream_of(spark, df, path, parts=1):
    """A file stream that delivers the rows in ``parts`` batches, in event order."""
    rows = df.orderBy("event_ts", "message_id").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def run(df, path, mode="append"):
    df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").outputMode(mode).trigger(
        availableNow=True
    ).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def delivered(spark, rows, schema, path, parts):
    """A stream that delivers the given lists of rows one after the other."""
    for i, part in enumerate(parts(rows) if callable(parts) else parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_fold_in_order_of_a_shuffled_feed(spark, chat, tmp_path):
    """Messages arrive up to two hours late, over three batches, and are folded as if in order; the last ones wait."""
    rng, rows = random.Random(4), chat.collect()
    rows.sort(key=lambda r: r.event_ts + dt.timedelta(minutes=rng.randint(0, 120)))
    size = -(-len(rows) // 3)
    feed = delivered(spark, rows, chat.schema, str(tmp_path / "in"), [rows[i * size:(i + 1) * size] for i in range(3)])
    out = str(tmp_path / "out")
    stream_folds.fold_in_order(feed, out, str(tmp_path / "ck"), dt.timedelta(hours=2)).trigger(availableNow=True).start().awaitTermination()
    actions, expected = spark.read.parquet(out + "/actions"), {}
    for messages in by_client(chat).values():
        state = NEW
        for m in messages:
            state, expected[m.message_id] = next_profile(state, m.text)
    waiting, profiles = stream_folds.waiting_effects(spark, out)
    folded = {r.message_id: r.action for r in actions.collect()}
    rest = {r.message_id: r.action for r in waiting.collect()}
    newest = max(r.event_ts for r in rows)
    assert rest and set(rest) == {r.message_id for r in rows if r.event_ts > newest - dt.timedelta(hours=2)}
    assert folded | rest == expected and not folded.keys() & rest.keys() and actions.filter("late").count() == 0
    sold = stream_folds.sales_from_chat(actions.filter("action = 'sales_text'").withColumn("business_type", F.lit(None).cast("string")))
    assert sold.count() == sum(m.text == "Frango, 2, 30" and folded.get(m.message_id) == "sales_text" for m in rows)


def test_messages_after_their_time_are_kept_and_marked(spark, tmp_path):
    schema = "client_id string, message_id string, event_ts timestamp, text string"
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    parts = [
        [("c", "m2", at(2), "1"), ("c", "m1", at(1), "Loja"), ("c", "m9", at(90), "6")], [("c", "m3", at(3), "3"), (None, "m0", None, "x")], [("d", "m8", at(300), "oi")],
    ]
    feed, out = delivered(spark, None, schema, str(tmp_path / "in"), parts), str(tmp_path / "out")
    stream_folds.fold_in_order(feed, out, str(tmp_path / "ck"), dt.timedelta(minutes=30)).trigger(availableNow=True).start().awaitTermination()
    got = {r.message_id: (r.action, r.late) for r in spark.read.parquet(out + "/actions").collect()}
    assert got["m1"] == ("set_name", False) and got["m2"] == ("set_business_type", False) and got["m3"] == ("set_cadence", True)
    assert got["m9"][1] is False and "m8" not in got
    assert [r.message_id for r in stream_folds.waiting_effects(spark, out)[0].collect()] == ["m8"]


def test_fold_in_batches_equals_message_by_message(spark, chat, tmp_path):
    stream = stream_of(spark, chat, str(tmp_path / "in"), 3)
    stream_folds.fold_in_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    actions, profiles = {}, {}
    for client, messages in by_client(chat).items():
        state = NEW
        for m in messages:
            state, actions[m.message_id] = next_profile(state, m.text)
        profiles[client] = state
    assert {r.message_id: r.action for r in spark.read.parquet(str(tmp_path / "out" / "actions")).collect()} == actions
    newest = windows.latest_updates(spark, str(tmp_path / "out" / "profiles"), ["client_id"]).collect()
    assert {r.client_id: (r.onboarding_step, r.name, r.business_type, r.cadence, r["mode"]) for r in newest} == profiles


def test_snapshots_and_released_tables(spark, tmp_path):
    path, made = str(tmp_path / "log"), []
    for i in range(7):
        spark.createDataFrame([("a", i), (f"b{i}", i)], "k string, v int").write.parquet(f"{path}/batch={i}")
        windows.compact(spark, path, ["k"], i, every=3)
    assert sorted(p.name for p in (tmp_path / "log").glob("base=*")) == ["base=2", "base=5"]
    assert {r.k: r.v for r in windows.latest_updates(spark, path, ["k"]).collect()} == {"a": 6} | {f"b{i}": i for i in range(7)}
    assert {r.k: r.v for r in windows.latest_updates(spark, path, ["k"], before=5).collect()} == {"a": 4} | {f"b{i}": i for i in range(5)}
    with staging.released(spark):
        made += staging.stage(spark.range(3), "gone").inputFiles()
    kept = staging.stage(spark.range(3), "kept")
    assert not any(os.path.exists(f.removeprefix("file://")) for f in made) and made and kept.count() == 3


def test_dedup_in_batches_never_forgets(spark, tmp_path):
    rows = [("m1", "a", START), ("m2", "a", START), ("m1", "a", START + dt.timedelta(days=90)), ("m3", "b", START + dt.timedelta(days=91)), ("", "b", START + dt.timedelta(days=92)), (None, "b", START + dt.timedelta(days=93))]
    stream = stream_of(spark, spark.createDataFrame(rows, "message_id string, client_id string, event_ts timestamp"), str(tmp_path / "in"), 3)
    windows.dedup_in_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    fresh = [r.message_id for r in spark.read.parquet(str(tmp_path / "out" / "fresh")).collect()]
    assert sorted(fresh, key=str) == ["", None, "m1", "m2", "m3"]
    assert sorted(r.message_id for r in SeenIds(spark, str(tmp_path / "out" / "seen")).ids().collect()) == ["m1", "m2", "m3"]


def test_stream_dedup_equals_batch(spark, chat, tmp_path):
    repeated = chat.unionByName(chat.filter("client_id < 'c15'")).unionByName(chat.limit(3).withColumn("message_id", F.lit("")))
    streamed = run(windows.dedup_events(stream_of(spark, repeated, str(tmp_path / "in"), 2)), str(tmp_path))
    batch = windows.dedup_events(repeated)
    count = lambda df: sorted((r.message_id, r.client_id) for r in df.collect())
    assert count(streamed) == count(batch) and streamed.count() == chat.count() + 3


def test_rates_and_running_figures(spark, chat, tmp_path):
    sales = chat.withColumns({"sale_ts": F.col("event_ts"), "amount": F.length("text").cast("double")})
    stream = stream_of(spark, sales, str(tmp_path / "in"), 3)
    for name, frame, keys in [
        ("rate", lambda df: windows.rate_windows(df, "1 hour", 4), ["client_id", "window_start"]), ("run", lambda df: windows.running_kpis(df), ["client_id", "day"]),
    ]:
        path = str(tmp_path / name)
        windows.write_updates(frame(stream), path, path + "-ck").trigger(availableNow=True).start().awaitTermination()
        newest = windows.latest_updates(spark, path, keys)
        batch = frame(sales).select(*newest.columns)
        assert sorted(map(str, newest.collect())) == sorted(map(str, batch.collect()))
    assert windows.rate_windows(sales, "1 day").filter("over_limit").count() == windows.rate_windows(sales, "1 day").filter("requests > 20").count()


def test_a_text_is_split_once(spark):
    """F8: the tests of a line work on short cuts of it; its numbers are not searched for again in every filter."""
    lines = "a,1,2\n b , 2.5 ,\xa03e2\nc,1e999,4\nd,nan,1\ne,1d,2\n,,\n f, .5,7. \n"
    df = spark.createDataFrame([("k", "s", "retalho", lines, dt.datetime(2026, 6, 1))], "client_id string, source_id string, business_type string, text string, received_at timestamp")
    sold = text_sales(df)
    assert [(r.item, r.quantity, r.amount) for r in sold.orderBy("row_ix").collect()] == [("a", 1.0, 2.0), ("b", 2.5, 300.0), ("f", 0.5, 7.0)]
    assert sold._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
