"""Smaller operators: sequence fallback, noise, metric-history verdict, binarise, sort, split ranges."""

from pyspark.sql import functions as F

from stormcell.operators import metrics as M
from stormcell.operators import quality as Q
from stormcell.operators import splits as T
from stormcell.operators import windows as WN
from stormcell.operators.series import Series


def test_sequence_fallback_when_every_window_has_a_gap(spark):
    rows = [(i, None if i % 3 == 0 else float(i), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, v double, y int").withColumn("ts", F.col("i"))
    s = Series(order=("i",), block_rows=16, bucket_width=10)
    out = WN.sequences_with_fallback(df, s, ["v"], "y", 5, 3, fallback=50, ts="ts")
    pos = [r[0] for r in out.select("position").orderBy("position").collect()]
    assert pos == list(range(5, 55))


def test_noise_is_seeded_and_small(spark):
    df = spark.range(2000).select(F.lit(1.0).alias("x"))
    a = T.add_noise(df, ["x"], 0.01, seed=3).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(a[0] - 1.0) < 0.002 and 0.008 < a[1] < 0.012


def test_history_verdict_and_best_row(spark):
    hist = spark.createDataFrame([(1, 0.5, 0.55, 0.90, 0.88), (2, 0.4, 0.70, 0.95, 0.85), (3, 0.3, 0.50, 0.97, 0.80)],
                                 "epoch int, loss double, val_loss double, auc double, val_auc double")
    best = T.best_row(hist.withColumn("run", F.lit(1)), ["run"], "val_loss", ["epoch"]).first()
    assert best["epoch"] == 3
    v = {r["epoch"]: r["verdict"] for r in T.history_verdict(hist, "loss", "val_loss", "auc", "val_auc").collect()}
    assert v == {1: "HEALTHY", 2: "OVERFITTING", 3: "OVERFITTING"}


def test_binarise_and_sort(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (0.2,)], "p double")
    assert [r[0] for r in df.select(M.binarise("p")).collect()] == [0, 1, 0]
    s = Series(order=("p",))
    assert [r[0] for r in Q.sort_series(df, s).collect()] == [0.2, 0.5, 0.51]


def test_split_range_matches_year_split(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2015-12-31 23:00:00', TIMESTAMP_NTZ'2021-01-03 01:00:00', "
                   "INTERVAL 12 HOURS)) AS ts")
    labelled = T.time_split(df, "ts")
    for name in ("train", "validation", "test"):
        a = labelled.where(F.col("split") == name).count()
        b = df.where(T.split_range(name, "ts")).count()
        assert a == b > 0
