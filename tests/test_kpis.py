import datetime as dt
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillwork.operators import kpis, periods, report
from tillwork.plans.reporting import due_reports, ingest, key_figures, record_reports, report_tables
from tillwork.schemas import CLIENTS
from tillwork.sources import sinks
from tillwork.sources.csv_files import read_csv_sources
from tillwork.staging import stage

AS_OF = dt.date(2026, 6, 7)


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("uploads")
    (folder / "c1").mkdir()
    shutil.copy(Path(__file__).parent / "data" / "sample_sales.csv", folder / "c1" / "sample.csv")
    clients = spark.createDataFrame([("c1", "retalho")], "client_id string, business_type string")
    sources, raw = read_csv_sources(spark, [str(folder)])
    return stage(ingest(sources, raw, clients)[0], "sample"), clients


def test_golden_sample(sample):
    sales, clients = sample
    rows, top = key_figures(sales, clients, AS_OF)
    r = rows.first()
    assert (r.total, r.transactions, round(r.avg_ticket, 4)) == (5695.5, 26, 219.0577)
    assert (r.best_day, r.peak_hour, r.month_name, r.change_pct, r.status) == (dt.date(2026, 6, 5), None, "June", None, "ok")
    ranked = kpis.with_shares(top).orderBy("rank").collect()
    assert [(t.item, t.quantity) for t in ranked] == [
        ("Cafe Moido", 218), ("Cha Verde", 135), ("Bolo de Milho", 109), ("Agua Mineral", 92), ("Pao Caseiro", 77),
    ]
    assert [round(t.share_pct, 1) for t in ranked] == [34.5, 21.4, 17.3, 14.6, 12.2]
    assert [round(t.ratio_to_max, 4) for t in ranked] == [1.0, 0.6193, 0.5, 0.422, 0.3532]


def test_revenue_by_day(sample):
    days = kpis.by_day(sample[0]).orderBy("day").collect()
    assert [d.revenue for d in days] == [512.5, 714.0, 726.5, 551.5, 1346.0, 821.5, 1023.5]
    changes = {d.day.day: d.change_pct for d in kpis.daily_change(kpis.by_day(sample[0])).collect()}
    assert changes[1] is None and changes[7] == 24.6


def test_today(sample):
    rows, top = key_figures(*sample, AS_OF, periods.TODAY)
    r = rows.first()
    assert (r.total, r.transactions, r.avg_ticket, r.vs_yesterday_pct) == (1023.5, 4, 255.875, 24.6)
    assert tuple(r.item_of_day) == ("Cafe Moido", 46, 575.0)
    assert [(t.item, t.quantity) for t in top.orderBy("rank").collect()] == [
        ("Cafe Moido", 46), ("Pao Caseiro", 41), ("Cha Verde", 28), ("Bolo de Milho", 13),
    ]


def test_first_day_has_no_change(sample):
    assert key_figures(*sample, dt.date(2026, 6, 1), periods.TODAY)[0].first().vs_yesterday_pct is None


def test_empty_period(sample):
    rows, top = key_figures(*sample, dt.date(2026, 7, 1), periods.TODAY)
    r = rows.first()
    assert (r.total, r.transactions, r.avg_ticket, r.best_day, r.status) == (0.0, 0, 0.0, dt.date(2026, 7, 1), "empty_period")
    assert top.count() == 0


@pytest.mark.parametrize("period,as_of,first,end", [
    ("hoje", AS_OF, AS_OF, dt.date(2026, 6, 8)),
    ("semana", AS_OF, dt.date(2026, 6, 1), dt.date(2026, 6, 8)),
    ("semana", dt.date(2026, 6, 8), dt.date(2026, 6, 8), dt.date(2026, 6, 9)),
    ("mes", dt.date(2026, 12, 31), dt.date(2026, 12, 1), dt.date(2027, 1, 1)),
    ("mes", dt.date(2024, 2, 29), dt.date(2024, 2, 1), dt.date(2024, 3, 1)),
])
def test_period_ranges(period, as_of, first, end):
    assert periods.period_range(period, as_of) == (first, end)


def test_unknown_period():
    with pytest.raises(ValueError):
        periods.period_range("ano", AS_OF)


def test_week_holds_the_whole_sample(sample):
    assert periods.filter_period(sample[0], "semana", AS_OF).count() == 26


def test_reference_frames(sales):
    """Goods, services and negative amounts."""
    goods = sales(
        {"amount": 150000.0, "item": "Rato Optico Pro", "quantity": 45.0}, {"amount": 250000.0, "item": "Teclado Mecanico", "quantity": 12.0},
        {"amount": 50000.0, "item": "Tapete Gaming", "quantity": 5.0}, sale_ts=dt.datetime(2026, 6, 7), client_id="goods",
    )
    services = sales(
        {"amount": 5000.0, "item": "Consultoria", "quantity": 1.0}, {"amount": 2500.0, "item": "Instalacao", "quantity": 2.0},
        sale_ts=dt.datetime(2026, 6, 7), client_id="services", business_type="servicos",
    )
    negative = sales({"amount": -100.0, "item": "X", "quantity": 1.0}, {"amount": 500.0, "item": "Y", "quantity": 2.0}, sale_ts=dt.datetime(2026, 6, 7), client_id="negative")
    everyone = goods.sparkSession.createDataFrame(
        [("goods", "retalho"), ("services", "SERVICOS"), ("negative", None), ("empty", "")], "client_id string, business_type string"
    )
    rows, _ = key_figures(goods.unionByName(services).unionByName(negative), everyone, AS_OF)
    got = {r.client_id: (r.total, r.transactions, r.avg_ticket, r.business_type, r.status) for r in rows.collect()}
    assert got == {
        "goods": (450000.0, 3, 150000.0, "retalho", "ok"), "services": (7500.0, 2, 3750.0, "servicos", "ok"),
        "negative": (500.0, 1, 500.0, "retalho", "ok"), "empty": (0.0, 0, 0.0, "retalho", "no_valid_rows"),
    }


def test_latest_year_and_statuses(sales):
    ok = {"amount": 1.0, "item": "x", "quantity": 1.0}
    df = sales(
        {**ok, "client_id": "typo", "sale_ts": dt.datetime(2025, 1, 1)}, {**ok, "client_id": "typo", "sale_ts": dt.datetime(2026, 1, 1)},
        {**ok, "client_id": "typo", "sale_ts": dt.datetime(2062, 1, 1)}, {**ok, "client_id": "dateless", "sale_ts": None},
        {**ok, "client_id": "plain", "sale_ts": dt.datetime(2026, 1, 1), "has_item": False, "item": None},
    )
    clients = df.select("client_id", "business_type").distinct()
    rows, _ = key_figures(df, clients, AS_OF)
    got = {r.client_id: (r.total, r.rows_outside_period, r.status) for r in rows.collect()}
    assert got == {"typo": (1.0, 2, "ok"), "dateless": (0.0, 0, "no_valid_dates"), "plain": (1.0, 0, "no_item_column")}


def test_peak_hour(sales):
    at = lambda h: {"sale_ts": dt.datetime(2026, 6, 7, h, 30)}
    tied = sales(at(14), at(9), at(14), at(9), client_id="tied")
    one = sales(at(14), at(14), client_id="one")
    late = sales(at(23), at(23), at(1), client_id="late")
    got = {r.client_id: r.peak_hour for r in kpis.peak_hour(tied.unionByName(one).unionByName(late)).collect()}
    assert got == {"tied": "09h-10h", "one": None, "late": "23h-24h"}


def test_services_without_quantity_rank_by_revenue(sales):
    rows = [{"item": "A", "amount": 50000.0}] + [{"item": "B", "amount": 200.0}] * 5
    services = sales(*rows, business_type="servicos", client_id="s")
    goods = sales(*rows, business_type="retalho", client_id="g")
    from tillwork.operators.silver import fill_fallbacks

    top = kpis.top_items(fill_fallbacks(services.unionByName(goods), AS_OF)).orderBy("client_id", "rank").collect()
    assert [(t.client_id, t.item, t.quantity) for t in top] == [("g", "B", 5), ("g", "A", 1), ("s", "A", 1), ("s", "B", 5)]


def test_ties_and_whole_quantities(sales):
    df = sales(*[{"item": i, "quantity": q, "amount": 1.0} for i, q in [("b", 2.9), ("a", 2.9), ("c", 3.5), ("d", 0.4), ("e", 9.0), ("f", 0.4)]])
    assert [(t.item, t.quantity) for t in kpis.top_items(df).orderBy("rank").collect()] == [("e", 9), ("c", 3), ("a", 2), ("b", 2), ("d", 0)]


def test_transactions_count_distinct_references(sales):
    df = sales({"order_ref": "1"}, {"order_ref": "1"}, {"order_ref": "2"}, {"order_ref": None}, amount=1.0)
    assert kpis.transactions(df).first().transactions == 2


def test_change_needs_both_days_and_revenue(sales):
    day = lambda d, a, c: {"sale_ts": dt.datetime(2026, 6, d), "amount": a, "client_id": c}
    df = sales(day(7, 90.0, "down"), day(6, 100.0, "down"), day(7, 5.0, "new"), day(7, 5.0, "zero"), day(6, 0.0, "zero"), day(6, 5.0, "gone"))
    got = {r.client_id: r.vs_yesterday_pct for r in kpis.vs_yesterday(df, AS_OF).collect()}
    assert got == {"down": -10.0, "new": None, "zero": None, "gone": None}


def test_exact_sums_do_not_depend_on_order(spark):
    df = spark.range(20000).select((F.col("id") % 977 / 100 + 0.125).alias("x"))
    sums = {df.repartition(n).agg(kpis.exact_sum("x")).first()[0] for n in (1, 3, 7)}
    assert len(sums) == 1


def test_report_tables(spark, sample, tmp_path):
    sales, _ = sample
    clients = spark.createDataFrame(
        [("c1", "Loja Azul", "retalho", "diario"), ("c2", None, "servicos", "diario"), ("c3", "Mes", "retalho", "mensal")],
        "client_id string, name string, business_type string, cadence string",
    )
    tables = report_tables(sales, clients, report.DAILY, AS_OF)
    texts = {r.client_id: r.summary for r in tables["summary_text"].collect()}
    assert texts == {
        "c1": "Resumo de hoje (07/06/2026):\nFaturação: 1023.50 MZN\nItens vendidos: 4\nTicket médio: 255.88 MZN\n"
              "Produto do dia: Cafe Moido (46 un)\nVs ontem: +24.6%",
        "c2": "Resumo de hoje (07/06/2026):\nFaturação: 0.00 MZN\nTransacções: 0\nValor médio/serviço: 0.00 MZN",
    }
    top = {r.client_id: r.top_text for r in tables["top_text"].collect()}
    assert top["c1"].startswith("Top 5 produtos (diario):\n1. Cafe Moido - 46 ocorrências\n2. Pao")
    assert top["c2"] == "Não foi possível identificar serviços no teu ficheiro."
    block = [(r.position, r.label, r.value) for r in tables["kpi_block"].filter("client_id = 'c1'").orderBy("position").collect()]
    assert block == [(1, "FATURACAO TOTAL", "MZN 1,023.50"), (2, "ITENS VENDIDOS", "4"), (3, "TICKET MEDIO", "MZN 255.88"), (4, "MELHOR DIA", "2026-06-07")]
    marks = {r.client_id: [x.value for x in tables["highlights"].filter(F.col("client_id") == r.client_id).orderBy("position").collect()] for r in clients.limit(2).collect()}
    assert marks == {"c1": ["Cafe Moido\n46 un . MZN 575.00", "-", "+ 24.6% vs ontem"], "c2": ["-", "-", "-"]}
    insight = {r.client_id: r.insight for r in tables["insights"].collect()}
    assert "O produto CAFE MOIDO lidera o periodo em volume." in insight["c1"] and "insuficiente" in insight["c2"]
    written = sinks.write_report(tables, str(tmp_path / "gold"), AS_OF, report.DAILY)
    for name, path in written.items():
        back = spark.read.parquet(path)
        assert back.count() == tables[name].count()
        assert back.filter((F.col("as_of") == F.lit(AS_OF)) & (F.col("run_cadence") == "diario")).count() == back.count()


def test_monthly_and_weekly_reports(spark, sample):
    sales, _ = sample
    for cadence, start in [("mensal", "Resumo do Mês (June):\nFaturação total: 5695.50 MZN\nTransacções: 26\n"), ("semanal", "Resumo da semana:\nFaturação total: 5695.50 MZN\nItens vendidos: 26\n")]:
        clients = spark.createDataFrame([("c1", "L", "retalho", cadence)], "client_id string, name string, business_type string, cadence string")
        text = report_tables(sales, clients, cadence, AS_OF)["summary_text"].first().summary
        assert text == start + "Ticket médio: 219.06 MZN\nMelhor dia: 2026-06-05"


def test_due_reports(spark, sample):
    rows = [
        ("c1", "Loja", "retalho", "semanal", "u/1.csv", None, 0, "[]", None, None), ("c2", "Sem", "retalho", None, None, None, 0, "[]", None, None),
        ("c3", "Novo", "retalho", "semanal", "u/3.csv", None, 2, "[]", None, None), ("c4", "Dia", "retalho", "diario", "u/4.csv", None, 0, "[]", None, None),
    ]
    clients = spark.createDataFrame(rows, CLIENTS)
    reports, reminders = due_reports(sample[0], clients, dt.datetime(2026, 6, 8, 8, 15))
    assert list(reports) == ["semanal"] and [r.client_id for r in reminders.collect()] == ["c2"]
    kpi = reports["semanal"]["kpis"]
    assert [(r.client_id, r.total) for r in kpi.collect()] == [("c1", 5695.5)]
    recorded = record_reports(clients, kpi, "gold/2026-06-08")
    assert {r.client_id: r.last_report for r in recorded.collect()} == {"c1": "gold/2026-06-08", "c2": None, "c3": None, "c4": None}
    assert due_reports(sample[0], clients, dt.datetime(2026, 6, 8, 12))[0] == {}


def test_sales_sinks(spark, sample, tmp_path):
    sales, _ = sample
    sinks.write_sales(sales, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.filter("sale_year = 2026 and sale_month = 6").count() == 26
    sinks.write_sales_csv(sales.select("item", "amount"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 26


def test_long_names_are_shortened(spark):
    name = "um nome de produto muito comprido"
    top = spark.createDataFrame([("c", 1, name, 3, 1.0), ("c", 2, "curto", 1, 1.0)], "client_id string, rank int, item string, quantity long, amount double")
    rows = report.top_chart(top).orderBy("rank").collect()
    assert [(r.short_name, r.count_label, r.share_label) for r in rows] == [(name.title()[:24] + "...", "3 oc.", "75% do total"), ("Curto", "1 oc.", "25% do total")]


def test_period_filter_reaches_the_scan(spark, sample, tmp_path):
    path = str(tmp_path / "flat")
    sample[0].write.parquet(path)
    plan = periods.filter_period(spark.read.parquet(path), "mes", AS_OF)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(sale_ts" in plan and "LessThan(sale_ts" in plan


def test_one_client_with_extreme_cells_does_not_stop_the_others(spark, sales):
    good = sales(*[{"amount": a, "quantity": 2.0} for a in (1.1, 2.2, 3.3)], client_id="good", item="x", order_ref="1", sale_ts=dt.datetime(2026, 6, 7))
    bad = sales(
        *[{"amount": a, "quantity": q} for a, q in ((1e15, 1e20), (1e30, 1e30), (1e22, 3.0), (5e307, 1e300), (1e308, 1e308))],
        client_id="bad", item="y", order_ref="2", sale_ts=dt.datetime(2026, 6, 7),
    )
    both = good.unionByName(bad)
    rows = {r.client_id: r for r in kpis.kpis(both, AS_OF, daily=True).collect()}
    assert rows["good"].total == 6.6 and rows["good"].item_of_day.quantity == 6
    assert rows["bad"].total == pytest.approx(1.5e308) and rows["bad"].item_of_day.quantity == pytest.approx(1e308)
    assert {r.client_id for r in kpis.with_shares(kpis.top_items(both)).collect()} == {"good", "bad"}
    from tillwork.streaming.windows import running_kpis

    assert {r.client_id: r.total for r in running_kpis(both).collect()}["good"] == 6.6
    reasons, _ = key_figures(both, spark.createDataFrame([("good", "retalho"), ("bad", "retalho")], "client_id string, business_type string"), AS_OF)
    assert {r.client_id: r.status for r in reasons.collect()} == {"good": "ok", "bad": "ok"}


def test_figures_keep_a_client_without_a_name(sales):
    rows = kpis.kpis(sales({"amount": 2.0, "quantity": 1.0, "item": "x"}, {"amount": 3.0, "quantity": 1.0, "item": "x"}, client_id=None, sale_ts=dt.datetime(2026, 6, 7)), AS_OF, daily=True).collect()
    assert [(r.client_id, r.total, r.item_of_day.item) for r in rows] == [(None, 5.0, "x")]


def test_reports_count_only_the_newest_upload(spark, sales, tmp_path):
    sale = {"amount": 100.0, "quantity": 1.0, "item": "x", "sale_ts": dt.datetime(2026, 6, 7), "client_id": "c"}
    twice = sales({**sale, "source_id": "one"}, {**sale, "source_id": "two"})
    uploads = spark.createDataFrame([("c", "one", 1), ("c", "two", 2)], "client_id string, source_id string, uploaded_at long")
    clients = spark.createDataFrame([("c", "L", "retalho", "semanal")], "client_id string, name string, business_type string, cadence string")
    total = lambda u: report_tables(twice, clients, "semanal", AS_OF, u)["kpis"].first().total
    assert (total(uploads), total(None)) == (100.0, 200.0)


def test_main_figures_read_costly_input_once(spark, tmp_path):
    rows = [(None, "2026-06-01", "a", 2.0, True), (None, "2026-06-02", "a", 3.0, True), (None, None, None, 1.0, False), ("c", "2026-06-02", "b", 3.0, True), ("c", "2026-06-01", None, 3.0, True), ("c", "2026-06-03", "z", None, False)]
    schema = "client_id string, sale_ts string, order_ref string, amount double, has_order boolean"
    spark.createDataFrame(rows, schema).withColumn("sale_ts", F.col("sale_ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "s"))
    figures = kpis.kpis(spark.read.parquet(str(tmp_path / "s")))
    got = {r.client_id: (r.total, str(r.best_day), r.transactions, r.avg_ticket) for r in figures.collect()}
    assert got == {None: (6.0, "2026-06-02", 2, 3.0), "c": (6.0, "2026-06-01", 2, 3.0)}
    plan = figures._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_stored_sales_are_pruned_by_month(spark, sales, tmp_path):
    rows = sales(*[{"sale_ts": dt.datetime(y, m, 15), "amount": 1.0} for y in (2025, 2026) for m in range(1, 13)], {"sale_ts": None, "amount": 1.0})
    sinks.write_sales(rows, str(tmp_path / "s"))
    read = sinks.read_sales(spark, str(tmp_path / "s"), dt.date(2025, 12, 1), dt.date(2026, 2, 1))
    assert sorted(r.sale_ts for r in read.collect()) == [dt.datetime(2025, 12, 15), dt.datetime(2026, 1, 15)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "sale_year" in pruned and "sale_month" in pruned
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 2


def test_change_against_the_day_before(spark):
    days = [("a", dt.date(2026, 6, d), float(v)) for d, v in ((1, 10), (2, 15), (4, 30))] + [("a", None, 7.0), (None, dt.date(2026, 6, 1), 4.0), (None, dt.date(2026, 6, 2), 2.0)]
    changed = kpis.daily_change(spark.createDataFrame(days, "client_id string, day date, revenue double"))
    got = {(r.client_id, r.day and r.day.day): (r.revenue_before, r.change_pct) for r in changed.collect()}
    assert got == {("a", 1): (None, None), ("a", 2): (10.0, 50.0), ("a", 4): (None, None), ("a", None): (None, None), (None, 1): (None, None), (None, 2): (4.0, -50.0)}
    assert changed._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_sketches_unite_days(spark, sales):
    rows = sales(*[{"client_id": "c", "sale_ts": dt.datetime(2026, 6, 1 + i % 3), "order_ref": f"o{i % 700}", "amount": 1.0, "has_order": True} for i in range(2000)],
                 {"client_id": "c", "sale_ts": dt.datetime(2026, 6, 1), "amount": 1.0, "has_order": False}, {"client_id": "d", "sale_ts": dt.datetime(2026, 6, 1), "amount": 1.0, "has_order": False})
    got = {r.client_id: r.transactions for r in kpis.about_transactions(kpis.order_sketches(rows)).collect()}
    assert got["d"] == 1 and abs(got["c"] - 701) <= 14


def test_cleaned_rows_are_read_once_for_the_facts(spark, sales, monkeypatch):
    """rows without a date are staged with the valid ones, so the facts read one table."""
    read = []
    facts = kpis.source_facts
    monkeypatch.setattr(kpis, "source_facts", lambda rows, *a: read.append(rows) or facts(rows, *a))
    df = sales({"amount": 5.0, "sale_ts": dt.datetime(2026, 6, 1)}, {"amount": 7.0, "sale_ts": None}, {"amount": 9.0, "sale_ts": dt.datetime(2025, 6, 1)})
    clients = spark.createDataFrame([("c", "retalho")], "client_id string, business_type string").unionByName(
        df.select("client_id", F.lit("retalho").alias("business_type")).distinct()).distinct()
    rows, _ = key_figures(df, clients, dt.date(2026, 6, 7))
    got = {r.client_id: r for r in rows.collect()}[df.first().client_id]
    assert (got.total, got.transactions, got.rows_outside_period) == (5.0, 1, 1)
    assert "Union" not in read[0]._jdf.queryExecution().optimizedPlan().toString()
