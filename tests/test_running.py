"""Running totals by ranges and quantiles by brackets, against numpy and brute force."""

import random
import time

import numpy as np
import pytest

from stormcell.operators import running as R
from stormcell.operators import splits as T


@pytest.mark.parametrize("buckets", [1, 5, 40])
def test_totals_with_null_keys_and_ties_of_keys(spark, buckets):
    rng = random.Random(buckets)
    rows = [(rng.choice([None, "a", "b", "b"]), i % 3, float(v), rng.randint(0, 4)) for i, v in enumerate(rng.sample(range(900), 900))]
    df = spark.createDataFrame(rows, "k string, j int, v double, n long")
    got = R.running_totals(df, ["k", "j"], "v", ["n"], n_buckets=buckets).collect()
    assert len(got) == 900
    for r in got:
        same = [(v, n) for k, j, v, n in rows if (k, j) == (r["k"], r["j"])]
        assert r["_total_n"] == sum(n for _, n in same)
        assert r["_before_n"] == sum(n for v, n in same if v < r["v"])


def test_totals_of_an_empty_table_and_without_keys(spark):
    df = spark.createDataFrame([(3.0, 2), (1.0, 5), (2.0, None)], "v double, n long")
    assert {r["v"]: (r["_before_n"], r["_total_n"]) for r in R.running_totals(df, [], "v", ["n"]).collect()} == {
        1.0: (0, 7), 2.0: (5, 7), 3.0: (5, 7)}
    assert R.running_totals(df.where("v > 9"), [], "v", ["n"]).collect() == []


def test_plan_has_no_cut_points_on_rows(spark):
    df = spark.range(1000).selectExpr("cast(id as double) v", "id n", "id % 3 k")
    plan = R.running_totals(df, ["k"], "v", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "filter(" not in plan


@pytest.mark.parametrize("accuracy", [4000, 20])
def test_brackets_hold_the_ranks(spark, accuracy):
    """With a coarse sketch too: heavy ties, nulls, infinities, one value only, no value."""
    rng = random.Random(accuracy)
    rows = [(i % 2, rng.gauss(0, 5) if i % 3 else rng.choice([1.0, 2.0]), float(rng.randint(0, 3)), 7.0, None,
             rng.choice([float("inf"), 1.0, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = R.exact_quantiles(df, ["a", "b", "c", "d"], probs, accuracy=accuracy).first()
    by = {r["k"]: r for r in R.exact_quantiles(df, ["a", "b", "c", "d"], probs, keys=["k"], accuracy=accuracy).collect()}
    for j, c in enumerate("abcd", 1):
        for i, p in enumerate(probs):
            if c == "d":
                assert got[f"d_q{i}"] is None and by[0][f"d_q{i}"] is None
                continue
            assert got[f"{c}_q{i}"] == pytest.approx(np.quantile([r[j] for r in rows], p), abs=1e-12)
            for k in (0, 1):
                assert by[k][f"{c}_q{i}"] == pytest.approx(np.quantile([r[j] for r in rows if r[0] == k], p), abs=1e-12)


def test_missed_brackets_fall_back(spark, monkeypatch):
    """A sketch whose bounds miss the rank is noticed and all values are ranked."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(R.F, "percentile_approx", lambda c, p, a: F.when(F.count(c) > 0, F.array(*[F.lit(-1.0)] * len(p))))
    df = spark.range(101).selectExpr("cast(id as double) v")
    assert R.exact_quantiles(df, ["v"], [0.5]).first()["v_q0"] == 50.0


def test_only_the_bracket_is_shuffled(spark):
    df = spark.range(0, 40000, 1, 4).selectExpr("cast(xxhash64(id) as double) v")
    seen = []
    whole = R.running_totals
    R.running_totals = lambda d, *a, **k: (seen.append(d.count()), whole(d, *a, **k))[1]
    try:
        R.exact_quantiles(df, ["v"], [0.25, 0.5, 0.75])
    finally:
        R.running_totals = whole
    assert 3 <= seen[0] < 0.05 * 40000


@pytest.mark.parametrize("rows, join", [(100_000, "BroadcastHashJoin"), (2, "SortMergeJoin")])
def test_rows_of_a_key_stay_where_they_are(spark, monkeypatch, rows, join):
    """Few statistics go to every task, whatever Spark thinks of their size; more than that are joined by a shuffle."""
    monkeypatch.setattr(R, "BROADCAST_ROWS", rows)
    df = spark.range(0, 300, 1, 4).selectExpr("id % 3 k", "cast(id as double) v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.attach_stats(df, df.groupBy("k").agg({"v": "max"}).toDF("k", "m"), ["k"])
        assert join in out._jdf.queryExecution().executedPlan().toString()
        assert {(r["k"], r["m"]) for r in out.collect()} == {(0, 297.0), (1, 298.0), (2, 299.0)}
        got = R.exact_quantiles(df, ["v"], [0.5], keys=["k"]).collect()
        assert {(r["k"], r["v_q0"]) for r in got} == {(0, 148.5), (1, 149.5), (2, 150.5)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_quantiles(spark):
    df = spark.createDataFrame([], "k int, a double")
    assert R.exact_quantiles(df, ["a"], [0.5]).first()["a_q0"] is None
    assert R.exact_quantiles(df, ["a"], [0.5], keys=["k"]).collect() == []


@pytest.mark.parametrize("ratio", [0.0, 0.001, 0.3, 1.0])
def test_exact_samples(spark, ratio):
    df = spark.range(500).selectExpr("id", "id % 7 AS x").unionByName(spark.range(100).selectExpr("id", "id % 7 AS x"))
    got = T.sample_exact(df, ratio, 5, "id")
    assert got.count() == int(ratio * 600) and got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.sample_exact(df.repartition(7), ratio, 5, "id").collect()))


def test_quantiles_of_many_columns_are_planned_soon(spark):
    """The planner's work does not double with every column (16 columns took 25 s, now 4 s)."""
    x = np.random.default_rng(8).normal(size=(2500, 18))
    df = R.cut_lineage(spark.createDataFrame(x.tolist(), [f"c{j}" for j in range(18)]))
    began = time.monotonic()
    got = R.exact_quantiles(df, df.columns, [0.25, 0.5, 0.75]).first()
    assert time.monotonic() - began < 45
    want = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    assert [[got[f"c{j}_q{i}"] for j in range(18)] for i in range(3)] == [pytest.approx(w) for w in want.tolist()]
