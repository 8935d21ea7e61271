"""The commit log, bucketed tables, the client store, seen ids and committed report runs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tillwork.operators import silver
from tillwork.plans.report_runs import ReportRuns
from tillwork.plans.reporting import key_figures, report_tables
from tillwork.plans.rollups import Rollup
from tillwork.schemas import CLIENTS
from tillwork.sources.buckets import BucketTable, create
from tillwork.sources.client_store import ClientStore
from tillwork.sources.commits import CommitLog, Conflict
from tillwork.streaming import seen, windows
from tillwork.streaming.fence import FenceState

START = dt.datetime(2026, 6, 1)


def folder_bytes(folder):
    folder = folder.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_one_of_two_runs_commits(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log.latest() == (-1, {})
    assert log.commit({"run": "ã"}, -1) == 0 and log.commit({"run": "b"}, 0) == 1
    with pytest.raises(Conflict):
        CommitLog(spark, str(tmp_path)).commit({"run": "late"}, 0)
    assert log.latest() == (1, {"run": "b"}) and log.read(0) == {"run": "ã"}
    # A commit that was cut off before its rename is not read.
    (tmp_path / "_log" / ".half").write_text("{")
    assert log.versions() == [0, 1] and log.forget(1) == [{"run": "b"}] and log.versions() == [1]


@pytest.fixture
def store(spark, tmp_path):
    rows = [(f"{i}", f"n{i}", None, None, None, None, i % 3, None, None, START) for i in range(200)]
    return ClientStore.create(spark.createDataFrame(rows, CLIENTS), str(tmp_path / "clients"), 8)


def test_merges_rewrite_touched_buckets_only(spark, store):
    _, _, before = store.current()
    store.insert_new(spark.createDataFrame([("+5",), ("new",)], "phone string"), F.lit(START))
    version, _, after = store.current()
    wanted = {str(r[0]) for r in spark.createDataFrame([("5",), ("new",)], "client_id string").select(before.bucket()).collect()}
    assert version == 1 and {b for b in after.folders if after.folders[b] != before.folders[b]} == wanted
    assert store.clients().count() == 201 and store.lookup(" +new ").first().onboarding_step == 1
    updates = spark.createDataFrame([("5", 1, ["mode"], "a"), ("5", 2, ["mode"], "b"), ("nobody", 1, ["mode"], "z")], "client_id string, at int, changed array<string>, mode string")
    store.update(updates, ["mode"], ["at"])
    assert {r["mode"] for r in store.clients().collect()} == {None, "b"} and store.lookup("5").first()["mode"] == "b"
    # The version before is still whole.
    assert before.read(spark).count() == 200
    assert store.current()[2].merged(updates.limit(0), lambda a, b: a) == store.current()[2]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_do_not_shuffle_clients(spark, store):
    phones = spark.range(1000).select((F.col("id") % 400).cast("string").alias("phone"))
    found = store.lookup_many(phones)
    assert plan_of(found).count("Exchange") == 1 and "Bucketed: true" in plan_of(found)
    assert found.filter("name is not null").count() == 600
    messages = phones.select(F.col("phone").alias("client_id"), F.lit("document").alias("type"))
    refused = store.refused_documents(messages)
    assert plan_of(refused).count("Exchange") == 1
    assert refused.count() == sum(int(i % 400) >= 200 or (i % 400) % 3 > 0 for i in range(1000))
    one = store.lookup("17")
    assert one.count() == 1 and len(one.inputFiles()) == 1


def test_tables_deal_appends_and_merge(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"), "id")
    table = create(rows, str(tmp_path), "k", 4)
    for _ in range(3):
        table = table.appended(rows.withColumn("k", F.concat(F.lit("x"), "k")))
    assert table.read(spark).count() == 400 and max(map(len, table.folders.values())) == 4
    merged = table.compacted(spark, 2)
    assert {len(f) for f in merged.folders.values()} == {1} and merged.read(spark).count() == 400
    wider = merged.dealt_anew(spark, 16)
    assert len(wider.folders) == 16 and wider.read(spark).distinct().count() == 200
    assert BucketTable(str(tmp_path), "k", "k string, id bigint", 4, {}).read(spark).count() == 0


def test_seen_ids_against_a_set(spark, tmp_path):
    store, known = seen.SeenIds(spark, str(tmp_path), count=2, rows=300), set()
    for batch in range(4):
        ids = {f"m{i}" for i in range(batch * 150, batch * 150 + 300)} | {"m0"}
        asked = spark.createDataFrame([(i, START) for i in sorted(ids)], "message_id string, created_at timestamp")
        assert {r[0] for r in store.seen_of(asked, batch).collect()} == ids & known
        store.add(asked.filter(~F.col("message_id").isin(sorted(known & ids) or [""])), batch)
        known |= ids
    assert sorted(r.message_id for r in store.ids().collect()) == sorted(known)
    # 750 ids: more than two buckets of 300 hold.
    assert BucketTable(**store._before(None)["ids"]).count == 4 and store.log.versions() == [2, 3]
    # A repeated batch sees only what came before it.
    assert store.seen_of(asked, 3).count() == 151


def test_what_a_batch_reads_does_not_grow(spark, tmp_path, monkeypatch):
    """New ids of every batch: filters are read, ids hardly ever, however many batches there were."""
    store, read, opened = seen.SeenIds(spark, str(tmp_path), count=4, rows=2000), BucketTable.read, []

    def reading(table, session, only=None):
        chosen = [f for b, fs in table.folders.items() if only is None or int(b) in set(only) for f in fs]
        opened.append(sum(map(folder_bytes, chosen)))
        return read(table, session, only)

    per_batch = []
    for batch in range(100):
        ids = spark.createDataFrame([(f"{batch}-{i}", START) for i in range(20)], "message_id string, created_at timestamp")
        monkeypatch.setattr(BucketTable, "read", reading)
        opened.clear()
        assert store.seen_of(ids, batch).count() == 0 if batch % 20 in (0, 19) else True
        if batch % 20 in (0, 19):
            per_batch.append(sum(opened))
        monkeypatch.setattr(BucketTable, "read", read)
        store.add(ids, batch)
    # Filters have a fixed number of pages, which fill in the first batches and are then of the same size.
    whole = len(BucketTable(**store._before(None)["filters"]).folders) * seen.PAGES * seen.PAGE_BITS // 8
    assert max(per_batch) <= whole and max(map(len, BucketTable(**store._before(None)["ids"]).folders.values())) <= seen.PARTS
    assert per_batch[-1] < 3 * per_batch[2]


def test_repeated_batch_of_the_stream(spark, tmp_path):
    """A batch whose commit was lost, or that is run again after it, leaves the same messages."""
    store = seen.SeenIds(spark, str(tmp_path / "seen"))
    first = spark.createDataFrame([("a", START), ("b", START)], "message_id string, created_at timestamp")
    store.add(first, 0)
    again = spark.createDataFrame([("b", START), ("c", START)], "message_id string, created_at timestamp")
    for _ in range(4):
        fresh = again.join(store.seen_of(again, 1), "message_id", "left_anti")
        assert [r.message_id for r in fresh.collect()] == ["c"]
        store.add(fresh, 1)
    assert sorted(r.message_id for r in store.ids().collect()) == ["a", "b", "c"]
    assert windows.BUCKETS == seen.BUCKETS


@pytest.fixture
def runs(spark, tmp_path):
    rows = [
        ("a", "Azul", "retalho", "semanal", None, None, 0, "[]", None, START), ("b", "Mar", "retalho", "mensal", None, None, 0, "[]", None, START),
        ("c", "Sem", "retalho", None, None, None, 0, "[]", None, START), ("d", "Novo", "retalho", "semanal", None, None, 2, "[]", None, START),
    ]
    return ReportRuns.create(spark.createDataFrame(rows, CLIENTS), str(tmp_path / "runs"), 2)


def uploads_of(spark, *uploads):
    """(client, source, time, amounts) as sources and raw cells."""
    header = ["data", "valor", "produto"]
    sources = [(source, client, "csv", header, at) for client, source, at, _ in uploads]
    raw = [(source, i, ["2026-05-30", str(v), "x"]) for _, source, _, amounts in uploads for i, v in enumerate(amounts)]
    return (
        spark.createDataFrame(sources, "source_id string, client_id string, format string, header array<string>, uploaded_at long"),
        spark.createDataFrame(raw, "source_id string, row_ix long, cells array<string>"),
    )


def seen_reports(runs):
    figures = runs.read("kpis")
    clients = {r.client_id: (r.last_file, (r.last_report or "").split("kpis/")[-1]) for r in runs.clients().collect()}
    return clients, figures and {r.client_id: (r.total, str(r.as_of)) for r in figures.collect()}


def test_a_run_counts_the_newest_upload_and_shows_when_committed(spark, runs, monkeypatch):
    assert seen_reports(runs) == ({c: (None, "") for c in "abcd"}, None)
    first = uploads_of(spark, ("a", "a1", 1, [10]), ("a", "a2", 2, [10, 20]), ("b", "b1", 1, [5]), ("d", "d1", 1, [9]), ("nobody", "n", 1, [7]))
    runs.run(*first, dt.datetime(2026, 6, 1, 8, 10))
    want = {"a": ("a2", "as_of=2026-06-01/run_cadence=semanal"), "b": ("b1", "as_of=2026-06-01/run_cadence=mensal"), "c": (None, ""), "d": ("d1", "")}
    assert seen_reports(runs) == (want, {"a": (30.0, "2026-06-01"), "b": (5.0, "2026-06-01")})
    assert [r.client_id for r in runs.read("reminders").collect()] == ["c"]
    assert {r.source_id: r.status for r in runs.status().collect()} == {"a2": "ok", "b1": "ok"}

    # A run that is stopped before its commit, with all its tables written, changes nothing that is read.
    second = uploads_of(spark, ("a", "a3", 3, [100]), ("c", "c1", 3, [1]))
    with monkeypatch.context() as patch:
        patch.setattr(CommitLog, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            runs.run(*second, dt.datetime(2026, 6, 8, 8, 10))
    assert seen_reports(runs) == (want, {"a": (30.0, "2026-06-01"), "b": (5.0, "2026-06-01")}) and runs.log.versions() == [0, 1]

    runs.run(*second, dt.datetime(2026, 6, 8, 8, 10))
    clients, figures = seen_reports(runs)
    assert clients["a"] == ("a3", "as_of=2026-06-08/run_cadence=semanal") and clients["b"] == want["b"] and clients["c"][0] == "c1"
    assert figures == {"a": (100.0, "2026-06-08"), "b": (5.0, "2026-06-01"), "c": (1.0, "2026-06-08")}
    assert runs.read("reminders").count() == 0


def test_sales_that_know_their_upload_count_once(spark, sales):
    sale = {"amount": 100.0, "quantity": 1.0, "item": "x", "sale_ts": dt.datetime(2026, 6, 7), "client_id": "c"}
    twice = sales({**sale, "source_id": "one"}, {**sale, "source_id": "two"}).withColumn("uploaded_at", F.when(F.col("source_id") == "one", 5).otherwise(3))
    clients = spark.createDataFrame([("c", "L", "retalho", "semanal")], "client_id string, name string, business_type string, cadence string")
    assert report_tables(twice, clients, "semanal", dt.date(2026, 6, 7))["kpis"].first().total == 100.0


def test_an_upload_replaces_its_own_source_only(spark, sales, tmp_path):
    day, as_of = dt.datetime(2026, 6, 7, 9, 30), dt.date(2026, 6, 7)
    base = {"quantity": 1.0, "item": "x", "sale_ts": day, "business_type": "retalho"}
    made = sales(
        *[{**base, "client_id": f"c{i}", "source_id": "one", "amount": 10.0, "order_ref": f"o{j}"} for i in range(20) for j in (1, 1, 2)],
        {**base, "client_id": "c3", "source_id": "two", "amount": 5.0, "order_ref": "o9"}, {**base, "client_id": "c3", "source_id": "two", "amount": -1.0, "order_ref": "o9"},
    )
    rollup = Rollup(spark, str(tmp_path / "rollup"))
    rollup.replace(made, as_of, 8)
    before = rollup.log.latest()[1]["rollup"]["folders"]
    clients = spark.createDataFrame([("c3", "retalho"), ("c4", "retalho"), ("none", "retalho")], "client_id string, business_type string")

    def figures():
        rows, top = rollup.figures(clients, as_of, "hoje")
        ranked = {r.client_id: r.quantity for r in top.collect()}
        return {r.client_id: (r.total, r.transactions, ranked.get(r.client_id), r.status) for r in rows.collect()}

    assert figures() == {"c3": (35.0, 3, 4, "ok"), "c4": (30.0, 2, 3, "ok"), "none": (0.0, 0, None, "no_valid_rows")}
    # The rows of one hour, item and order are one row of the rollup.
    assert {r.order_ref: r.rows for r in rollup.rows().filter("client_id = 'c4'").collect()} == {"o1": 2, "o2": 1}
    rollup.replace(sales({**base, "client_id": "c3", "source_id": "two", "amount": 8.0, "order_ref": "o7"}), as_of)
    after = rollup.log.latest()[1]["rollup"]["folders"]
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and figures()["c3"] == (38.0, 3, 4, "ok")
    # An upload without a good row takes its source's old rows away.
    rollup.replace(sales({**base, "client_id": "c3", "source_id": "one", "amount": -8.0, "order_ref": "o7"}), as_of)
    assert figures()["c3"] == (8.0, 1, 1, "ok") and figures()["c4"] == (30.0, 2, 3, "ok")
    same, _ = key_figures(made.filter("client_id = 'c4'"), clients, as_of, "hoje")
    assert {r.client_id: (r.total, r.transactions) for r in same.collect()}["c4"] == (30.0, 2)


def test_fence_of_batches_is_that_of_all_rows(spark, sales, tmp_path):
    """Sources that grow from batch to batch, one whose limit goes again, and a repeated batch."""
    parts = [
        [("a", 10.0), ("a", 11.0), ("a", 12.0), ("b", 5.0), ("b", 6.0), ("b", 7.0), ("b", 100.0)],
        [("a", 13.0), ("a", 1000.0), ("b", 90.0), ("b", 95.0), ("b", 110.0), ("c", 1.0)], [("a", 12.5), ("a", -3.0), ("a", None), ("c", float("nan"))],
    ]
    rows = [sales(*[{"client_id": c, "source_id": "s", "amount": v} for c, v in part]) for part in parts]
    state, found = FenceState(spark, str(tmp_path / "state"), 2), {}
    for i, part in enumerate(rows):
        for _ in range(3 if i == 1 else 1):
            found |= {r.client_id: r.fence for r in state.add(part, i).collect()}
    whole = rows[0].unionByName(rows[1]).unionByName(rows[2])
    limits = {r.client_id: r.fence for r in silver.fence_limits(whole).collect()}
    assert limits.keys() == {"a"} and {c: f for c, f in found.items() if f is not None} == limits and found["b"] is None


def test_event_queries_count_values_of_zero_and_less(spark, tmp_path):
    """such values move the quartiles and are rows of the week, in the queries as in their SQL."""
    import duckdb

    import __spark_entry__ as entry

    values = {1: [0.0, 0.0, 0.0, 10.0, 11.0, 12.0, 13.0, 40.0], 2: [-50.0, -40.0, -0.0, 10.0, 11.0, 12.0, 13.0, 150.0], 3: [0.0], 4: [-5.0, -4.0, -4.5, -3.0, 90.0]}
    flat = [(u, v) for u, vs in values.items() for v in vs]
    rows = [(i, dt.datetime(2024, 1, 31, 10), u, "view", v) for i, (u, v) in enumerate(flat)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("iqr_fence", "stream_fence", "rollup_periods"):
        found = entry.queries()[name](spark, str(tmp_path))
        got = sorted(tuple(r) for r in found.collect())
        cursor = con.execute(entry.oracle_sql()[name])
        order = [[d[0] for d in cursor.description].index(c) for c in found.columns]
        assert got == sorted(tuple(r[i] for i in order) for r in cursor.fetchall()), name


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """rows of one bucket do not meet in one task when they are many; the table reads as before."""
    from pyspark.sql import functions as F

    from tillwork.sources import buckets

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(40000).repartition(8).select((F.col("id") % 50).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set(name, "100KB")
    try:
        table = buckets.create(rows, str(tmp_path), "k", 1)
    finally:
        spark.conf.unset(name)
    assert len(list(tmp_path.glob("data/*/bucket=0/*.parquet"))) > 1
    assert table.read(spark).groupBy("k").count().filter("count = 800").count() == 50
