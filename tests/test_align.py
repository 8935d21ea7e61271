import datetime as dt
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillwork.operators import align
from tillwork.plans.reporting import ingest
from tillwork.sources.csv_files import read_csv_sources, split_line
from tillwork.sources.page_tables import read_page_tables

SAMPLE = Path(__file__).parent / "data" / "sample_sales.csv"


def mapped(spark, header, kind="retalho", override=None):
    df = spark.createDataFrame([("s", header, kind)], "source_id string, header array<string>, business_type string")
    return align.map_headers(df, override).first()


CASES = [
    (["data", "quantidade", "valor", "produto"], ["data", "quantidade", "valor", "produto"]),
    (["data", "quantidade", "valor", "servico"], ["data", "quantidade", "valor", "servico"]),
    (["date", "qty", "total", "produto"], ["data", "quantidade", "valor", "produto"]),
    (["Unit Price", "Discount", "Media", "Produto", "Total"], ["valor", "quantidade", "data", "produto", "total"]),
    (
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
        ["l_orderkey", "l_partkey", "l_suppkey", "quantidade", "l_quantity", "valor", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "data"],
    ),
    (["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], ["o_orderkey", "o_custkey", "o_orderstatus", "valor", "data", "o_orderpriority"]),
    # Fields that are already there are not given to a second column.
    (["valor", "date", "total"], ["valor", "data", "total"]),
    (["amount", "quantidade", "total", "date"], ["amount", "quantidade", "valor", "data"]),
    ([" DATA ", "Valor", "valor"], ["data", "valor", "valor"]),
    (["", None, "data", "valor"], [None, None, "data", "valor"]),
]


@pytest.mark.parametrize("header,names", CASES)
def test_header_names(spark, header, names):
    row = mapped(spark, header)
    assert row.names == names and row.status == "ok"


@pytest.mark.parametrize("header", [["nome", "descricao"], ["event_id", "ts", "user_id", "event_type", "value", "props"]])
def test_missing_columns(spark, header):
    assert mapped(spark, header).status == "missing_columns"


def test_roles(spark):
    row = mapped(spark, ["id", "subtotal", "data", "valor", "preco_total", "qtd", "servico", "produto"], "servicos")
    # The leftmost total wins, and it is no candidate for the price.
    assert (row.total_ix, row.price_ix, row.quantity_ix, row.date_ix, row.order_ix, row.item_ix) == (2, 5, 6, 3, 1, 7)
    assert mapped(spark, ["data", "preco_total", "qtd", "valor"]).price_ix is None
    assert mapped(spark, ["data", "servico", "produto", "valor"], "retalho").item_ix == 3
    assert mapped(spark, ["data", "servico", "produto", "valor"], "outro").item_ix == 2
    assert mapped(spark, ["data", "valor", "quantidade"]).item_ix is None


def test_override(spark):
    fix = spark.createDataFrame([("s", 1, 2, None)], "source_id string, date_ix int, total_ix int, quantity_ix int")
    row = mapped(spark, ["quando", "dinheiro"], override=fix)
    assert (row.status, row.date_ix, row.total_ix) == ("ok", 1, 2)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    shutil.copy(SAMPLE, tmp_path / "a" / "sample.csv")
    (tmp_path / "b" / "one.csv").write_text("data,quantidade,valor,produto\n2026-06-07,10,500,Arroz\n")
    (tmp_path / "b" / "two.csv").write_text('﻿Total,Date,Qty,produto,Data\n"1.500,00",03/06/2026 10:00,2,"X, ""y""",\nN/A,2026-06-02,1,Z,\n')
    (tmp_path / "b" / "empty.csv").write_text("")
    (tmp_path / "b" / "bad.csv").write_text("nome,descricao\nJoao,Produto X\n")
    (tmp_path / "b" / "other.txt").write_text("nada")
    return tmp_path


def test_csv_files(spark, files):
    listed = [(p.parent.name, f"file://{p}") for p in sorted(files.glob("*/*"))]
    uploads = spark.createDataFrame(listed, "client_id string, source_id string")
    clients = spark.createDataFrame([("a", "retalho"), ("b", None)], "client_id string, business_type string")
    sources, raw = read_csv_sources(spark, [str(files)], uploads=uploads)
    sales, status = ingest(sources, raw, clients)
    got = {Path(r.source_id).name: (r.rows, r.status) for r in status.collect()}
    assert got == {
        "sample.csv": (26, "ok"), "one.csv": (1, "ok"), "two.csv": (2, "ok"), "empty.csv": (0, "empty"),
        "bad.csv": (1, "missing_columns"), "other.txt": (0, "unsupported_format"),
    }
    rows = {(r.sale_ts, r.item, r.quantity, r.amount) for r in sales.filter("client_id = 'b'").collect()}
    # The empty column named Data is dropped before columns are matched, so Date is the date.
    assert rows == {
        (dt.datetime(2026, 6, 7), "Arroz", 10.0, 500.0), (dt.datetime(2026, 6, 3, 10), 'X, "y"', 2.0, 1500.0), (dt.datetime(2026, 6, 2), "Z", 1.0, None),
    }
    assert sales.filter("client_id = 'a'").count() == 26


@pytest.mark.parametrize("line, cells", [
    ("a,b,,c", ["a", "b", "", "c"]), ("", [""]), (",", ["", ""]), ('"a,b",c', ["a,b", "c"]), ('"say ""hi"", you",1', ['say "hi", you', "1"]),
    ('"",x', ["", "x"]), ('5" tube,2', ['5" tube', "2"]), ('"open, end', ['"open', " end"]), ('"a"b,c', ['"a"b', "c"]), (' "a" ,b', [' "a" ', "b"]),
    ('"two\nlines",x', ["two\nlines", "x"]), ('"' + "y" * 100_000 + '"', ["y" * 100_000]), ("é,ü;x\t,", ["é", "ü;x\t", ""]),
])
def test_cells_of_a_record(spark, line, cells):
    assert spark.createDataFrame([(line,)], "line string").select(split_line(F.col("line")).alias("c")).first().c == cells


def test_a_wide_file_does_not_widen_the_others(spark, tmp_path):
    for client, header, row in [("wide", ["data", "valor", *(f"x{i}" for i in range(4998))], ["2026-06-07", "5", *["1"] * 4998]), ("thin", ["valor", "data", "vazio"], ["7", "2026-06-08", "N/A"])]:
        (tmp_path / client).mkdir()
        (tmp_path / client / "f.csv").write_text(",".join(header) + "\n\n" + (",".join(row) + "\n") * 3)
    sources, raw = read_csv_sources(spark, [str(tmp_path)])
    assert sorted({len(r.cells) for r in raw.collect()}) == [3, 5000]
    # The text itself is read by the one job that stores the records.
    for df in (sources, raw):
        plan = df._jdf.queryExecution().toString()
        assert "FileScan text" not in plan and "FileScan csv" not in plan
    live = {r.client_id: [n for n in r.header if n] for r in align.live_headers(raw, sources).collect()}
    assert live["thin"] == ["valor", "data"] and len(live["wide"]) == 5000
    clients = spark.createDataFrame([], "client_id string, business_type string")
    sales, status = ingest(sources, raw, clients)
    assert {(r.client_id, r.amount) for r in sales.collect()} == {("wide", 5.0), ("thin", 7.0)} and {r.status for r in status.collect()} == {"ok"}


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "f.csv").write_text('data,valor,produto\n2026-06-07,5,"two\nlines"\n')
    sources, raw = read_csv_sources(spark, [str(tmp_path)], multiline=True)
    clients = spark.createDataFrame([], "client_id string, business_type string")
    assert [r.item for r in ingest(sources, raw, clients)[0].collect()] == ["two\nlines"]


def test_wide_sources_keep_their_live_columns(spark):
    width = 130
    header = [f"x{i}" for i in range(width - 2)] + ["data", "valor"]
    cells = [None] * (width - 2) + ["2026-01-01", "5"]
    sources = spark.createDataFrame([("s", "c", "csv", header)], "source_id string, client_id string, format string, header array<string>")
    raw = spark.createDataFrame([("s", 0, cells), ("s", 1, ["v", *cells[1:]])], "source_id string, row_ix long, cells array<string>")
    live = align.live_headers(raw, sources).first()
    assert live.rows == 2 and [n for n in live.header if n] == ["x0", "data", "valor"]


def test_page_tables(spark):
    tables = [
        ("d", "c", 0, 0, [["data", "valor", None], ["2026-06-01", "5", "k"]]),
        ("d", "c", 0, 1, [["so cabecalho", "x", "y"]]),
        ("d", "c", 1, 0, [["valor", "extra", "data"], ["7,50", "e", "02/06/2026"], ["N/A", "f", "x"]]),
        ("scan", "c", 0, 0, []),
    ]
    df = spark.createDataFrame(tables, "source_id string, client_id string, page int, table_ix int, cells array<array<string>>")
    sources, raw = read_page_tables(df)
    assert {r.source_id: r.header for r in sources.collect()} == {"d": ["data", "valor", "coluna_2", "extra"], "scan": None}
    assert sorted(r.cells[0] for r in raw.collect()) == ["02/06/2026", "2026-06-01", "x"]
    clients = spark.createDataFrame([("c", "retalho")], "client_id string, business_type string")
    sales, status = ingest(sources, raw, clients)
    assert sorted((r.amount for r in sales.collect()), key=str) == [5.0, 7.5, None]
    assert {r.source_id: r.status for r in status.collect()} == {"d": "ok", "scan": "empty"}


def test_typed_once(spark):
    """A total with three decimals keeps its value as number text, and is not read a second time."""
    sources = spark.createDataFrame([("s", "c", "csv", ["data", "valor", "preco", "qtd"])], "source_id string, client_id string, format string, header array<string>")
    raw = spark.createDataFrame([("s", 0, ["2026-01-01", "0,125", "0,1", "3"])], "source_id string, row_ix long, cells array<string>")
    clients = spark.createDataFrame([("c", "retalho")], "client_id string, business_type string")
    row = ingest(sources, raw, clients)[0].first()
    assert (row.amount, row.unit_price, row.quantity) == (0.125, 0.1, 3.0)
