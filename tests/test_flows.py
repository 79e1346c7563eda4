"""Early stopping, blend flow, hourly spine, input gate, ROC start point."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormcell.operators import alerts as A
from stormcell.operators import metrics as M
from stormcell.operators import models as MD
from stormcell.operators import quality as Q
from stormcell.operators.series import Series, hourly_spine


def test_best_round():
    assert MD.best_round([5, 4, 3, 4, 4, 1], 2) == (3, True)
    assert MD.best_round([5, 4, 3, 4, 2], 2) == (5, False)
    assert MD.best_round([1.0], 2) == (1, False)


def _rows(spark, n=600):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(scale=0.7, size=n) > 0.4).astype(int)
    rows = [(*map(float, a), int(b), "validation" if i % 3 == 0 else "train") for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "a double, b double, c double, y int, split string")


def test_early_stopping_keeps_the_best_round(spark):
    d = _rows(spark).cache()
    train, val = d.where("split = 'train'"), d.where("split = 'validation'")
    small = {"maxDepth": 2, "stepSize": 0.5}
    m = MD.fit_gbt_patient(train, val, ["a", "b", "c"], "y", patience=4, maxIter=32, **small)
    whole = MD.fit_gbt(train, ["a", "b", "c"], "y", maxIter=32, **small)
    held = MD.assembler(["a", "b", "c"]).transform(val).select("features", F.col("y").cast("double").alias("y"))
    losses = whole.stages[-1].evaluateEachIteration(held)
    keep, _ = MD.best_round(losses, 4)
    assert m.stages[-1].getNumTrees == keep > 1
    assert m.stages[-1].evaluateEachIteration(held) == pytest.approx(losses[:keep])
    with pytest.raises(A.MissingFeatures):
        MD.score(val.drop("b"), m)
    d.unpersist()


def test_predict_batch_names_missing_columns(spark):
    with pytest.raises(A.MissingFeatures, match="no_such"):
        A.predict_batch(_rows(spark, 3), "a", ["no_such"])


def test_blend_flow_applies_the_best_trial(spark):
    d = _rows(spark).select("split", "y", *[(1 / (1 + F.exp(-F.col(c)))).alias(c) for c in "abc"])
    rates, weights = MD.blend_flow(d, ["a", "b", "c"], "y", "split", [[0.1, 0.1, 1.0], [1.0, 0.5, 0.0], [0.0, 1.0, 0.2]])
    pdf = d.toPandas()
    assert weights == pytest.approx({"a": 2 / 3, "b": 1 / 3, "c": 0.0})
    s = np.floor((pdf["a"] * 2 / 3 + pdf["b"] / 3) * 1e6 + 0.5) / 1e6
    val = pdf["split"] == "validation"

    def f1(t):
        hit, y = s[val] >= t, pdf["y"][val] == 1
        return 2 * (hit & y).sum() / (2 * (hit & y).sum() + (hit & ~y).sum() + (~hit & y).sum())
    got = {r["split"]: r for r in rates.collect()}
    t = got["train"]["threshold"]
    assert f1(t) == pytest.approx(max(f1(x) for x in s[val]))
    assert got["train"]["tp"] == ((s >= t) & (pdf["y"] == 1) & ~val).sum()


def test_hourly_spine(spark):
    h = lambda day, hour: dt.datetime(2024, 1, day, hour, 30)
    rows = [("a", h(1, 22), 1.0), ("a", h(2, 1), 2.0), ("a", h(2, 1), 3.0), (None, h(3, 5), 4.0), (None, h(3, 7), 5.0),
            ("b", h(1, 0), 6.0), ("b", None, 7.0), ("c", None, 8.0)]
    d = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = sorted((r["k"] or "", r["ts"].day, r["ts"].hour, -1 if r["v"] is None else r["v"])
                 for r in hourly_spine(d, ["k"]).collect())
    assert got == [("", 3, 5, 4.0), ("", 3, 6, -1), ("", 3, 7, 5.0), ("a", 1, 22, 1.0), ("a", 1, 23, -1), ("a", 2, 0, -1),
                   ("a", 2, 1, 2.0), ("a", 2, 1, 3.0), ("b", 1, 0, 6.0)]
    assert hourly_spine(d.limit(0), ["k"]).count() == 0


def test_fill_without_backward(spark):
    d = spark.createDataFrame([(0, None), (1, 5.0), (2, None)], "i int, v double")
    s = Series(order=("i",), block_rows=2)
    assert [r["v"] for r in Q.fill_all(d, s, ["v"], backward=False).orderBy("i").collect()] == [0.0, 5.0, 5.0]


def test_roc_starts_at_zero(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.4)], "y int, p double")
    got = sorted((r["fpr"], r["tpr"]) for r in M.roc_curve(d, "y", "p").collect())
    assert got == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
