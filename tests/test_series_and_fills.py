"""Fills, windows and the block/halo layout against pandas semantics and the plain window."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stormcell.operators import quality as Q
from stormcell.operators import windows as WN
from stormcell.operators.series import Series, fitted, with_neighbours, with_positions


def _series(spark, values, key=None):
    rows = [(i, v if v is None or not math.isnan(v) else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i long, v double")
    if key is not None:
        df = df.withColumn("k", F.lit(key))
    return df


def _pandas_fill(values, limit=6, ffill=2):
    s = pd.Series([np.nan if v is None else v for v in values], dtype="float64")
    s = s.interpolate(method="linear", limit=limit, limit_area="inside")
    return s.ffill(limit=ffill).tolist()


CASES = [
    [1.0, None, None, None, None, None, None, None, None, None, 11.0],        # gap 9
    [1.0, None, None, None, None, None, None, 8.0],                           # gap 6
    [1.0, None, None, None, None, None, None, None, 9.0],                     # gap 7
    [None, None, 3.0, 4.0, None, None, None, None],                           # leading + trailing
    [2.0, None, 4.0, None, None, 10.0, None, None, None, None, None, None, None, None, None, None, None, 0.0],
]


@pytest.mark.parametrize("method,block", [("plain", 1 << 20), ("blocked", 3), ("blocked", 4)])
@pytest.mark.parametrize("values", CASES)
def test_interpolate_matches_pandas(spark, values, method, block):
    s = Series(order=("i",), method=method, block_rows=block, bucket_width=5)
    got = Q.interpolate(_series(spark, values), s, ["v"]).orderBy("i").select("v").toPandas()["v"].tolist()
    want = _pandas_fill(values)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None or math.isnan(g)
        else:
            assert g == pytest.approx(w, rel=1e-12, abs=1e-12)


def test_fills_never_change_present_values(spark):
    rnd = random.Random(3)
    vals = [None if rnd.random() < 0.4 else rnd.uniform(-5, 5) for _ in range(300)]
    s = Series(order=("i",), block_rows=17, bucket_width=40)
    out = Q.interpolate(_series(spark, vals), s, ["v"]).orderBy("i").toPandas()["v"].tolist()
    for a, b in zip(vals, out):
        if a is not None:
            assert a == b
    full = Q.fill_all(_series(spark, vals), s, ["v"]).orderBy("i").toPandas()["v"].tolist()
    ser = pd.Series([np.nan if v is None else v for v in vals]).ffill().bfill().fillna(0).tolist()
    assert full == pytest.approx(ser)


def test_ffill_limit(spark):
    vals = [1.0, None, None, None, 5.0, None]
    s = Series(order=("i",), block_rows=2, bucket_width=3)
    got = Q.ffill(_series(spark, vals), s, ["v"], 1).orderBy("i").toPandas()["v"].tolist()
    want = pd.Series([np.nan if v is None else v for v in vals]).ffill(limit=1).tolist()
    assert [None if (isinstance(x, float) and math.isnan(x)) else x for x in want] == \
        [None if (isinstance(x, float) and math.isnan(x)) else x for x in got]


def test_positions_are_dense_and_ordered(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.randint(0, 10_000)) for k in range(3) for _ in range(400)]
    df = spark.createDataFrame(rows, "k long, t long").dropDuplicates()
    s = Series(keys=("k",), order=("t",), bucket_width=97)
    p = with_positions(df, s).toPandas().sort_values(["k", "t"])
    for _, g in p.groupby("k"):
        assert g["_pos"].tolist() == list(range(len(g)))


@pytest.mark.parametrize("block", [5, 24, 25, 1000])
def test_block_halo_equals_plain_window(spark, block):
    rnd = random.Random(block)
    rows = [(k, i, None if rnd.random() < 0.1 else rnd.gauss(0, 1)) for k in range(2) for i in range(180)]
    df = spark.createDataFrame(rows, "k long, i long, v double")

    def run(method):
        s = Series(keys=("k",), order=("i",), method=method, block_rows=block, bucket_width=31)
        d = WN.lags(df, s, ["v"], [1, 3, 24])
        d = WN.rolling(d, s, ["v"], [3, 24])
        d = WN.lead_label(d, s, "v", 6, "v_ahead")
        return d.orderBy("k", "i").toPandas()

    a, b = run("plain"), run("blocked")
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12, atol=1e-12)


def test_rolling_matches_pandas_min_periods(spark):
    vals = [1.0, None, 3.0, 4.0, None, None, 7.0, 8.0]
    s = Series(order=("i",), block_rows=3, bucket_width=4)
    d = WN.rolling(_series(spark, vals), s, ["v"], [3]).orderBy("i").toPandas()
    ps = pd.Series([np.nan if v is None else v for v in vals])
    assert d["v_mean_3h"].tolist() == pytest.approx(ps.rolling(3, min_periods=1).mean().tolist(), nan_ok=True)
    assert d["v_std_3h"].fillna(-1).tolist() == pytest.approx(ps.rolling(3, min_periods=1).std().fillna(-1).tolist())


def test_sequences(spark):
    vals = [float(i) for i in range(20)]
    vals[7] = None
    df = _series(spark, vals).withColumn("ts", F.col("i")).withColumn("y", (F.col("i") % 2).cast("int"))
    s = Series(order=("i",), block_rows=6, bucket_width=5)
    out = WN.sequences(df, s, ["v"], "y", 4, 3, True, ts="ts").orderBy("position").toPandas()
    # targets 4, 7, 10, 13, 16, 19; windows containing row 7 (targets 10 only: rows 6..9) are skipped
    assert out["position"].tolist() == [4, 7, 13, 16, 19]
    assert [list(map(lambda r: r[0], x)) for x in out["sequence"]][0] == [0.0, 1.0, 2.0, 3.0]


def test_clean_drops_multi_flag_and_keeps_first_duplicate(spark):
    rows = [(0, 0, 5.0, 500.0, 1.0), (1, 0, 5.0, 500.0, 1.0), (1, 1, 6.0, 600.0, 2.0), (2, 0, 500.0, 5000.0, 999.0)]
    df = spark.createDataFrame(rows, "ts long, seq int, IMF_Bz double, Flow_Speed double, Proton_Density double")
    df = df.withColumn("IMF_By", F.col("IMF_Bz") * 2).withColumn("IMF_Bx", F.col("IMF_Bz") * 3)
    s = Series(order=("ts", "seq"), block_rows=2, bucket_width=10)
    out = Q.clean(df, s).orderBy("ts").toPandas()
    assert out["ts"].tolist() == [0, 1]
    assert out["IMF_Bz"].tolist() == [5.0, 5.0]


def test_hot_key_spans_many_blocks_and_matches_plain(spark):
    rows = [(0, i, float(i % 7)) for i in range(1500)] + [(k, i, float(i)) for k in range(1, 6) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    blocked = Series(keys=("k",), order=("i",), block_rows=100, bucket_width=50)
    plain = Series(keys=("k",), order=("i",), method="plain")
    a = WN.rolling(WN.lags(df, blocked, ["v"], [1, 24]), blocked, ["v"], [24]).orderBy("k", "i").toPandas()
    b = WN.rolling(WN.lags(df, plain, ["v"], [1, 24]), plain, ["v"], [24]).orderBy("k", "i").toPandas()
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-12, atol=1e-12)
    pos = with_positions(df, blocked)
    blocks = pos.where(F.col("k") == 0).select(F.floor(F.col("_pos") / 100).alias("b")).distinct().count()
    assert blocks == 15
    filled = Q.fill_all(df.withColumn("v", F.when(F.col("i") % 5 == 0, F.col("v"))), blocked, ["v"])
    assert filled.where(F.col("v").isNull()).count() == 0


def test_small_series_need_no_blocks(spark):
    """Keys of no more rows than a block: one exchange by key, the same rows as in blocks; larger keys stay in blocks."""
    rng = np.random.default_rng(3)
    rows = [(None if k == 0 else k, int(t) // 2, None if rng.random() < 0.5 else float(rng.normal())) for k in range(8) for t in range(30)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    blocked = Series(keys=("k",), order=("i",), block_rows=30, bucket_width=5)
    dealt, plain = fitted(df, blocked)
    assert plain.method == "plain" and fitted(df, Series(keys=("k",), order=("i",), block_rows=29))[1].method == "blocked"
    out = WN.rolling(Q.interpolate(dealt, plain, ["v"]), plain, ["v"], [3])
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("repartition") == 1 and "join" not in plan and "unboundedfollowing" not in plan
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    cut = Series(keys=("k",), order=("i",), block_rows=7, bucket_width=5)
    want = WN.rolling(Q.interpolate(df, cut, ["v"]), cut, ["v"], [3])
    as_rows = lambda d: sorted((r["k"], r["i"], repr(r["v"]), repr(r["v_mean_3h"])) for r in d.collect())
    assert as_rows(out) == as_rows(want) and out.count() == 210
    nxt = with_neighbours(df.where("k is not null"), cut, ["v"])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert nxt.count("unboundedfollowing") == 1  # over the blocks' summary only, not over rows
