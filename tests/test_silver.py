import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwork import staging
from tillwork.operators import quantiles, silver

DAY = dt.date(2026, 6, 7)


def kept_and_reasons(df):
    valid, rejects = silver.clean(df, DAY)
    return sorted(r.row_ix for r in valid.collect()), {r.row_ix: r.reason for r in rejects.collect()}


def test_row_checks_in_order(sales):
    ts = dt.datetime(2026, 6, 7)
    ok = {"sale_ts": ts, "amount": 10.0, "quantity": 1.0, "item": "x", "order_ref": "7", "order_name": "id"}
    df = sales(
        ok, {**ok, "amount": None}, {**ok, "amount": -100.0}, {**ok, "amount": 0.0}, {**ok, "quantity": 0.0}, {**ok, "quantity": None},
        {**ok, "item": None}, {**ok, "order_ref": "ID"}, {**ok, "order_ref": None}, {**ok, "is_blank": True}, {**ok, "sale_ts": None},
        {**ok, "amount": float("nan")}, {**ok, "amount": float("inf")}, {**ok, "amount": 1e15}, {**ok, "amount": None, "quantity": 0.0},
    )
    kept, reasons = kept_and_reasons(df)
    assert kept == [0, 8, 13]
    assert reasons == {
        1: "bad_total", 2: "bad_total", 3: "bad_total", 4: "bad_quantity", 5: "bad_quantity", 6: "missing_item", 7: "repeated_header",
        9: "blank_row", 10: "bad_date", 11: "bad_total", 12: "outlier", 14: "bad_total",
    }


@pytest.mark.parametrize("total,ok", [(20.0, True), (22.0, True), (22.01, False), (99999.0, False), (18.0, True), (17.99, False)])
def test_cross_check(sales, total, ok):
    df = sales({"amount": total, "quantity": 2.0, "unit_price": 10.0, "sale_ts": dt.datetime(2026, 1, 1)})
    assert (silver.cross_check(df).count() == 1) is ok


def test_cross_check_needs_both_positive(sales):
    df = sales({"amount": 5.0, "quantity": 2.0, "unit_price": 0.0}, {"amount": 5.0, "quantity": 2.0, "unit_price": None})
    assert silver.cross_check(df).count() == 2


@pytest.mark.parametrize("amounts,cut", [
    ([10, 11, 12, 13, 1000], [1000]), ([10, 11, 1000], []), ([10, 10, 10, 10, 1000], []), ([10, 11, 12, 13, 19], []), ([10, 11, 12, 13, 19.5], [19.5]),
])
def test_fence(sales, amounts, cut):
    df = sales(*[{"amount": float(a), "sale_ts": dt.datetime(2026, 1, 1)} for a in amounts])
    left = [r.amount for r in silver.iqr_fence(df).collect()]
    assert sorted(left) == sorted(a for a in amounts if a not in cut)
    assert [r.amount for r in silver.clean(df, DAY)[1].collect()] == cut


def test_derived_totals_and_fallbacks(sales):
    valid, _ = silver.clean(sales({"unit_price": 2.5, "quantity": 4.0}, {"unit_price": None, "quantity": 4.0}), DAY)
    rows = valid.collect()
    assert [(r.amount, r.sale_ts) for r in rows] == [(10.0, dt.datetime(2026, 6, 7))]
    valid, _ = silver.clean(sales({"item": "x"}), DAY)
    assert [(r.amount, r.quantity) for r in valid.collect()] == [(0.0, 1.0)]


@pytest.mark.parametrize("limit", [0, staging.BROADCAST_BYTES])
def test_quartiles_equal_numpy(spark, monkeypatch, limit):
    """With one group holding most rows, equal values, and the join that is not broadcast."""
    monkeypatch.setattr(staging.attach, "__defaults__", ("left", None, limit))
    rng = random.Random(5)
    groups = {"hot": [round(rng.lognormvariate(5, 2), 2) for _ in range(4000)], "flat": [7.0] * 50, "one": [3.5], "two": [1.0, 9.0]}
    groups["close"] = [1000 + rng.random() / 100 for _ in range(501)]
    groups |= {f"g{i}": [round(rng.uniform(0.01, 500), 2) for _ in range(rng.randint(3, 40))] for i in range(30)}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, amount double").repartition(6)
    got = {r.k: r for r in quantiles.quartiles(df, ["k"]).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert (got[k].total, got[k].top) == (len(vs), max(vs))
        assert (got[k].q1, got[k].q3) == tuple(np.percentile(vs, [25, 75])), k


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(spark, how):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    values = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = staging.attach(rows, values, ["k"], how)
    salted = staging.attach(rows, values, ["k"], how, broadcast_bytes=-1)
    assert "_salt" not in salted.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def test_fence_is_per_dataset(sales):
    rows = [{"client_id": "a", "amount": float(x)} for x in (10, 11, 12, 13, 50)] + [{"client_id": "b", "amount": float(x)} for x in (10, 40, 70, 90, 100)]
    kept = silver.iqr_fence(sales(*rows))
    assert {(r.client_id, r.amount) for r in kept.collect()} == {(r["client_id"], r["amount"]) for r in rows} - {("a", 50.0)}


def test_fence_of_a_client_without_a_name(sales):
    kept = silver.iqr_fence(sales(*[{"client_id": c, "source_id": s, "amount": float(x)} for c, s in ((None, "s"), ("a", None)) for x in (10, 11, 12, 13, 50)]))
    assert sorted((r.amount, r.client_id is None) for r in kept.collect()) == sorted((float(x), c) for x in (10, 11, 12, 13) for c in (True, False))


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        staging.shared_folder(Session())


def test_quartiles_of_null_keys_and_odd_values(spark):
    rng = random.Random(9)
    groups = {None: [round(rng.lognormvariate(3, 1), 3) for _ in range(2000)], "": [5.0], "inf": [1.0, 2.0, float("inf"), float("inf")], "far": [5e-324, 1e300, 1e308]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("nan", float("nan")), ("none", None), ("minus", -1.0)], "k string, amount double")
    got = {r.k: r for r in quantiles.quartiles(df, ["k"]).collect()}
    assert set(got) == set(groups)
    for k in (None, "", "far"):
        assert (got[k].q1, got[k].q3) == pytest.approx(tuple(np.percentile(groups[k], [25, 75]))), k
    assert got["inf"].q3 == float("inf") and got["inf"].q1 == 1.75


def test_values_are_read_again_only_for_open_ranks(spark, monkeypatch):
    """groups whose bins tell every rank need no second look, however many they are."""
    df = spark.createDataFrame([(k, float(10 ** i + k)) for k in range(40) for i in range(1, 6)], "k int, amount double")
    monkeypatch.setattr(quantiles, "_values_at", lambda *a: pytest.fail("all ranks were known"))
    got = {r.k: (r.q1, r.q3, r.total) for r in quantiles.quartiles(df, ["k"]).collect()}
    assert got == {k: (100.0 + k, 10000.0 + k, 5) for k in range(40)}
