"""Metrics, thresholds and alerts: brute force on small frames and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormcell.functions import alerts as AL
from stormcell.operators import alerts as A
from stormcell.operators import metrics as M
from stormcell.operators import models as MD
from stormcell.operators.running import exact_quantiles, running_totals


def _scored(spark, n=400, seed=1, ties=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = 1 if rnd.random() < 0.3 else 0
        p = rnd.random() * 0.6 + 0.3 * y
        if ties:
            p = round(p, 2)
        rows.append((i, y, p, "a" if i % 2 else "b"))
    return spark.createDataFrame(rows, "id long, y int, p double, g string"), rows


def _auc_brute(rows):
    pos = [r[2] for r in rows if r[1] == 1]
    neg = [r[2] for r in rows if r[1] == 0]
    tot = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


def test_auc_brute_force_and_symmetry(spark):
    df, rows = _scored(spark)
    got = M.auc(df, "y", "p").first()["auc"]
    assert got == pytest.approx(_auc_brute(rows), abs=1e-12)
    flipped = M.auc(df.withColumn("p", 1 - F.col("p")), "y", "p").first()["auc"]
    assert flipped == pytest.approx(1 - got, abs=1e-12)


def test_auc_by_group(spark):
    df, rows = _scored(spark, 300, 4)
    got = {r["g"]: r["auc"] for r in M.auc(df, "y", "p", ["g"]).collect()}
    for g in ("a", "b"):
        assert got[g] == pytest.approx(_auc_brute([r for r in rows if r[3] == g]), abs=1e-12)


def test_average_precision_and_pr_curve(spark):
    df, rows = _scored(spark, 200, 7)
    thresholds = sorted({r[2] for r in rows})
    P = sum(r[1] for r in rows)
    ap, prev_r = 0.0, 0.0
    for t in reversed(thresholds):
        tp = sum(1 for r in rows if r[2] >= t and r[1] == 1)
        fp = sum(1 for r in rows if r[2] >= t and r[1] == 0)
        rec = tp / P
        ap += (rec - prev_r) * tp / (tp + fp)
        prev_r = rec
    assert M.average_precision(df, "y", "p").first()[0] == pytest.approx(ap, abs=1e-12)
    curve = M.pr_curve(df, "y", "p").toPandas()
    assert len(curve) == len(thresholds) + 1
    end = curve[curve["threshold"].isna()].iloc[0]
    assert end["precision"] == 1.0 and end["recall"] == 0.0


def test_threshold_choice_ties_lowest(spark):
    rows = [(0, 0, 0.2), (1, 1, 0.4), (2, 1, 0.6), (3, 0, 0.8)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    curve = M.pr_curve(df, "y", "p")
    best = M.choose_thresholds(curve).where(F.col("strategy") == "max_f1").first()
    f1 = curve.where(F.col("threshold").isNotNull()).toPandas()
    top = f1[f1["f1"] == f1["f1"].max()]["threshold"].min()
    assert best["threshold"] == top


def test_confusion_rates_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, d int")
    r = M.rates(M.confusion(df, "y", "d")).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0 and r["accuracy"] == 1.0
    assert r["detection_rate"] is None


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(11)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5]) if i % 3 else rnd.gauss(0, 5) for i in range(501)]
    df = spark.createDataFrame([(v, v * 2) for v in vals], "a double, b double")
    q = exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75], n_buckets=7).first()
    for i, p in enumerate([0.25, 0.5, 0.75]):
        assert q[f"a_q{i}"] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-12)
        assert q[f"b_q{i}"] == pytest.approx(float(np.percentile([v * 2 for v in vals], p * 100)), abs=1e-12)


def test_running_totals_exact_with_many_buckets(spark):
    rows = [(i % 3, float(i), 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v double, n long")
    rt = running_totals(df, ["k"], "v", ["n"], n_buckets=13).toPandas()
    for k, g in rt.groupby("k"):
        g = g.sort_values("v")
        assert g["_before_n"].tolist() == list(range(len(g)))


def test_alert_levels_boundaries(spark):
    ps = [0.0, 0.19999, 0.2, 0.30999, 0.31, 0.39, 0.4, 0.6, 0.8, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(AL.alert_level("p")).collect()]
    assert got == ["NONE", "NONE", "WATCH", "WATCH", "LOW", "LOW", "MODERATE", "HIGH", "CRITICAL", "CRITICAL"]
    conf = [r[0] for r in df.select(AL.confidence("p", 0.309059)).collect()]
    assert conf[0] == "HIGH" and conf[4] == "LOW"


def test_alert_distribution_has_all_levels(spark):
    df = spark.createDataFrame([(0.9,), (0.1,)], "p double")
    d = A.alert_distribution(df, "p").toPandas()
    assert sorted(d["alert_level"]) == sorted(AL.ALL_LEVELS)
    assert d["count"].sum() == 2


def test_require_columns(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(A.MissingFeatures, match="b"):
        A.require_columns(df, ["a", "b"])


def test_blend_identity_and_normalise(spark):
    df, _ = _scored(spark, 50)
    d = MD.blend(df.withColumn("q", F.col("p") * 0.5), {"p": 1.0, "q": 0.0}, "b").toPandas()
    assert (d["b"] == d["p"]).all()
    with pytest.raises(ValueError):
        MD.normalise({"a": 0.0})


def test_weight_search_matches_python(spark):
    df, rows = _scored(spark, 120, 9, ties=False)
    df = df.withColumn("q", 1 - F.col("p"))
    trials = [[1.0, 0.0], [0.3, 0.7], [0.5, 0.5]]
    got = {r["trial"]: r["f1"] for r in MD.search_weights(df, ["p", "q"], "y", trials).collect()}
    for i, (a, b) in enumerate(trials):
        tp = fp = fn = 0
        for _, y, p, _ in rows:
            hit = (a * p + b * (1 - p)) / (a + b) >= 0.5
            tp += hit and y == 1
            fp += hit and y == 0
            fn += (not hit) and y == 1
        assert got[i] == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)


def test_target_fallback_to_closest_point(spark):
    # precision never reaches 0.7 together with recall 0.7: the closest point is reported
    rows = [(i, 1 if i % 2 else 0, float(i % 10) / 10) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    curve = M.pr_curve(df, "y", "p")
    out = M.choose_thresholds(curve).toPandas().set_index("strategy")
    assert out.loc["target", "achievable"] == False  # noqa: E712
    pts = curve.where(F.col("threshold").isNotNull()).toPandas()
    dist = (pts["precision"] - 0.7).abs() + (pts["recall"] - 0.7).abs()
    best = pts[dist == dist.min()]["threshold"].min()
    assert out.loc["target", "threshold"] == best


def test_model_table_gains(spark):
    df, rows = _scored(spark, 300, 12, ties=False)
    df = df.withColumn("q", 1 - F.col("p"))
    tab = M.model_table(df, "y", ["p", "q"], "p").toPandas().set_index("model")
    assert tab.loc["p", "auc_gain"] == 0.0
    assert tab.loc["q", "auc"] == pytest.approx(1 - tab.loc["p", "auc"], abs=1e-12)
    assert tab.loc["q", "auc_gain"] == pytest.approx(tab.loc["q", "auc"] - tab.loc["p", "auc"], abs=1e-12)
