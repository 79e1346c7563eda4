"""Tagged reads, observed ingest, noise, sequences by array frames, keyed stream state."""

import datetime as dt
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormcell.operators import splits as T
from stormcell.operators import windows as WN
from stormcell.operators.series import Series
from stormcell.sources import files as SRC
from stormcell.sources import text as TX
from stormcell.streaming import streams as X


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_read_tagged_is_one_scan(spark):
    base = folder()
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(f"{base}/one part+1")
    spark.createDataFrame([(2,), (3,)], "a int").coalesce(1).write.parquet(f"{base}/two")
    spark.createDataFrame([(4,)], "a int").coalesce(1).write.parquet(f"{base}/three")
    file = [f"{base}/three/{f}" for f in os.listdir(f"{base}/three") if f.endswith(".parquet")][0]
    df = SRC.read_tagged(spark, [f"{base}/one part+1", f"{base}/two/", f"file://{file}"], "part", ["p1", "p2", "p3"])
    assert sorted((r["a"], r["b"], r["part"]) for r in df.collect()) == [(1, "x", "p1"), (2, None, "p2"), (3, None, "p2"), (4, None, "p3")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Union" not in plan
    with pytest.raises(ValueError):
        SRC.read_tagged(spark, [base, base + "/"], "part", [1, 2])


def test_observed_ingest_writes_rows_and_rejects(spark):
    base = folder()
    os.mkdir(f"{base}/in")
    with open(f"{base}/in/a.txt", "w") as f:
        f.write("1996  122  0   5.1  -2.0   1.0  0.5  99999.9   4.0  400.0  2.1  30  -12   100\n")
        f.write("1996  122  x   5.1  -2.0   1.0  0.5  99999.9   4.0  400.0  2.1  30  -12   100\n")
        f.write("garbage\n\n")
        f.write("1996  122  999  5.1  -2.0   1.0  0.5  9.9   4.0  400.0  2.1  30  -12   100\n")
    rows, rejects, counts = TX.ingest_written(spark, f"{base}/in", f"{base}/out")
    assert counts == {"lines": 5, "rejects": 4, "missing": 1}
    assert rows.count() == 1 and rows.first()["Proton_Temp"] is None and str(rows.first()["ts"]) == "1996-05-01 00:00:00"
    assert sorted(r["line"].strip()[:7] for r in rejects.collect()) == ["", "1996  1", "1996  1", "garbage"]
    again, rejected = TX.ingest(spark, f"{base}/in")
    assert again.count() == 1 and rejected.count() == 4
    from stormcell.operators import models as MD
    d = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "x double, y int")
    assert MD.score(d, MD.fit_logistic(d, ["x"], "y"), "p").count() == 20  # the session still fits and scores


@pytest.mark.parametrize("method, key", [("xxhash64", "id"), ("mult", "id")])
def test_noise_does_not_depend_on_partitions(spark, method, key):
    df = spark.range(4000).selectExpr("id", "0.0D AS x", "1.0D AS y")
    one = {r["id"]: (r["x"], r["y"]) for r in T.add_noise(df, ["x", "y"], 0.5, 3, key, method).collect()}
    two = {r["id"]: (r["x"], r["y"]) for r in T.add_noise(df.repartition(7), ["x", "y"], 0.5, 3, key, method).collect()}
    other = {r["id"]: r["x"] for r in T.add_noise(df, ["x"], 0.5, 4, key, method).collect()}
    assert one == two and one[5][0] != other[5]
    if method == "mult":  # the engine-independent hash is no good generator, only the same everywhere
        return
    x, y = np.array([v[0] for v in one.values()]), np.array([v[1] - 1 for v in one.values()])
    for v in (x, y):
        assert abs(v.mean()) < 0.04 and abs(v.std() - 0.5) < 0.03 and abs((np.abs(v) < 0.5).mean() - 0.683) < 0.03
    assert abs(np.corrcoef(x, y)[0, 1]) < 0.08


@pytest.mark.parametrize("length, stride, check", [(5, 1, True), (5, 2, True), (6, 3, False), (4, 7, True), (3, 3, False)])
@pytest.mark.parametrize("block", [4, 1 << 20])
def test_sequences_equal_slices(spark, length, stride, check, block):
    rng = random.Random(length * stride)
    rows = [(k, i, float(i), None if rng.random() < 0.06 else float(i * 10 + k), i % 2) for k in range(2) for i in range(40 - 30 * k)]
    df = spark.createDataFrame(rows, "k int, ts int, a double, b double, y int").repartition(3)
    s = Series(keys=("k",), order=("ts",), block_rows=block, bucket_width=8)
    got = {(r["k"], r["position"]): (r["ts"], r["sequence"], r["label"]) for r in WN.sequences(df, s, ["a", "b"], "y", length, stride, check).collect()}
    want = {}
    for k in range(2):
        mine = [r for r in rows if r[0] == k]
        for t in range(length, len(mine), stride):
            window = [[r[2], r[3]] for r in mine[t - length:t]]
            if not check or all(v is not None for w in window for v in w):
                want[k, t] = (mine[t][1], window, mine[t][4])
    assert got == want


def test_late_rows_and_a_restart(spark):
    base = folder()
    src, out, ck = (f"{base}/{x}" for x in ("src", "out", "ck"))
    t = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    schema = "event_id long, user_id long, ts timestamp, value double"
    batches = [[(0, 1, t(0), 5.0), (1, 1, t(10), 1.0), (2, 1, t(30), 2.0), (10, 2, t(5), 7.0)],
               [(3, 1, t(20), 9.0), (4, 1, t(40), 3.0)],            # event 3 is late: features of 2 change
               [(5, 1, t(400), 4.0)], [(6, 1, t(1), 100.0), (7, 1, t(410), 6.0)]]  # event 6 is behind the watermark
    s = Series(keys=("user_id",), order=("ts", "event_id"))
    for rows in batches:  # one run per arrival: every run is a restart from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        X.stream_lag_features(X.read_stream(spark, src, spark.createDataFrame([], schema).schema), s, ["value"], [1], [2], out, None, ck)
    got = {r["event_id"]: (r["value_lag_1"], r["value_mean_2"]) for r in X.latest(spark.read.parquet(out), ["event_id"]).collect()}
    assert got == {0: (None, 5.0), 1: (5.0, 3.0), 3: (1.0, 5.0), 2: (9.0, 5.5), 4: (2.0, 2.5), 5: (3.0, 3.5), 7: (4.0, 5.0), 10: (None, 7.0)}
    touched = spark.read.parquet(out).groupBy("epoch").agg(F.collect_set("user_id").alias("u")).collect()
    assert sum(2 in r["u"] for r in touched) == 1  # the key without new rows is not written again


def test_many_keys_share_a_state(spark):
    """A state and a call hold a bucket of keys; null keys and large whole numbers beside nulls stay as they are, idle keys keep their tail."""
    base = folder()
    src, out, ck = (f"{base}/{x}" for x in ("src", "out", "ck"))
    t = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    big, schema = 2**60 + 1, "event_id long, user_id long, ts timestamp, value double"
    batches = [[(big + k, k if k else None, t(10 + k), float(k)) for k in range(40)] + [(None, 0, t(9), 5.0)],
               [(big + 100 + k, k if k else None, t(20 + k), None if k == 3 else 1.0) for k in range(0, 40, 3)] + [(None, 0, t(200), None)],
               [(big + 200, 1, t(9000), 1.0)], [(big + 300, 1, t(9001), 3.0), (big + 301, 2, t(9001), 7.0)]]
    s = Series(keys=("user_id",), order=("ts", "event_id"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        X.stream_lag_features(X.read_stream(spark, src, spark.createDataFrame([], schema).schema), s, ["value"], [1], [2], out, None, ck, buckets=2)
    got = {(r["event_id"], r["user_id"], r["ts"]): (r["value_lag_1"], r["value_mean_2"]) for r in spark.read.parquet(out).collect()}
    want, last = {}, {}
    for e, u, at, v in [r for rows in batches for r in rows]:
        seen = [x for x in (last.get(u), v) if x is not None]
        want[e, u, at] = (last.get(u), sum(seen) / len(seen) if seen else None)
        last[u] = v
    assert got == want
    assert spark.read.format("statestore").load(ck).count() == 2


def test_open_hours_come_from_the_stream(spark):
    base = folder()
    src, out, ck = (f"{base}/{x}" for x in ("src", "out", "ck"))
    ev = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=25 * i), 1, "click", float(i), "{}") for i in range(30)],
                               X.EVENTS_SCHEMA)
    for k in range(3):
        X.arrive(ev, (F.col("event_id") / 10).cast("int"), src, k)
        X.run_updates(X.hourly_means(X.read_stream(spark, src, X.EVENTS_SCHEMA), "2 hours"), out, ck)
    got = {(r["hour"], r["event_type"]): (r["mean_value"], r["events"]) for r in X.latest(spark.read.parquet(out), ["hour", "event_type"]).collect()}
    want = {(r["h"], "click"): (r["m"], r["n"]) for r in ev.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(
        F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_nothing_stays_persisted(spark):
    from stormcell.plans import catalog as C
    for name in ("e12_e16_thresholds", "n1_robust_scale", "c20_clean"):
        C.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
