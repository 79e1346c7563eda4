"""Evaluation (E1-E23).  Inputs: a scored table with label ``y`` and score ``p``, optional group keys.

Curves and ranking metrics first reduce the table to one row per (group, distinct
score) with positive and negative counts (a partial aggregate), then use the
distributed ``running_totals`` — no global window over all rows.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import safe_div, zero_div
from .running import attach_stats, exact_quantiles, running_totals

F1_EPS = 1e-10
TARGET_P = 0.70
TARGET_R = 0.70
# Generalisation verdict limits (val - test AUC) and the expected production metrics
AUC_DROP_LIMITS = ((0.02, "EXCELLENT"), (0.05, "GOOD"))
AUC_DROP_ELSE = "WARNING"
EXPECTED_PRIMARY = {"precision": 0.6180, "recall": 0.7001, "f1_score": 0.6565}
EXPECTED_TOLERANCE = 0.05


def _attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-group statistics joined by the group keys; one-row statistics added as literals."""
    return df.join(stats, on=list(by)) if by else attach_stats(df, stats)


def binarise(p, t: float = 0.5) -> Column:
    """Decision p > t (trainer convention)."""
    c = F.col(p) if isinstance(p, str) else p
    return (c > F.lit(float(t))).cast("int")


def confusion(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """TN, FP, FN, TP."""
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(F.count(F.when(~yy & ~pp, 1)).alias("tn"), F.count(F.when(~yy & pp, 1)).alias("fp"),
                               F.count(F.when(yy & ~pp, 1)).alias("fn"), F.count(F.when(yy & pp, 1)).alias("tp"))


def rates(conf: DataFrame) -> DataFrame:
    """E2 + E9 from confusion counts: accuracy, precision, recall, F1 (0 for 0/0), false-alarm and detection rates."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    prec, rec = zero_div(tp, tp + fp), zero_div(tp, tp + fn)
    d = conf.withColumns({"accuracy": zero_div(tp + tn, tn + fp + fn + tp), "precision": prec, "recall": rec})
    d = d.withColumn("f1", zero_div(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                    F.col("precision") + F.col("recall")))
    return d.withColumns({"false_alarm_rate": safe_div(fp, tn + fp), "detection_rate": safe_div(tp, fn + tp)})


def score_counts(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score): positives, negatives.  Rows without score or label take no part."""
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("long").alias("neg"))


def _curve_base(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score: tp/fp = counts with score >= s, P, N."""
    rt = running_totals(score_counts(df, y, p, by), by, "score", ["pos", "neg"])
    return rt.select(*by, "score", "pos", "neg",
                     (F.col("_total_pos") - F.col("_before_pos")).alias("tp"),
                     (F.col("_total_neg") - F.col("_before_neg")).alias("fp"),
                     F.col("_before_neg").alias("neg_below"),
                     F.col("_total_pos").alias("P"), F.col("_total_neg").alias("N"))


def auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC, exact with ties: sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N)."""
    c = _curve_base(df, y, p, by)
    return c.groupBy(*by).agg(safe_div(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)),
                                       F.first("P") * F.first("N")).alias("auc"))


def roc_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = (), start_point: bool = True) -> DataFrame:
    """One point per distinct score (threshold = score): fpr, tpr; plus the start point (0, 0), where nothing is
    called positive (no threshold)."""
    c = _curve_base(df, y, p, by)
    curve = c.select(*by, F.col("score").alias("threshold"), safe_div("fp", "N").alias("fpr"),
                     safe_div("tp", "P").alias("tpr"))
    if start_point:
        starts = c.groupBy(*by).agg(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                                    F.lit(0.0).alias("tpr"))
        curve = curve.unionByName(starts)
    return curve


def average_precision(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """E5: sum over thresholds of (R_n - R_(n-1)) * P_n = sum_s pos_s / P * precision(s)."""
    c = _curve_base(df, y, p, by)
    return c.groupBy(*by).agg(F.sum(safe_div("pos", "P") * safe_div("tp", F.col("tp") + F.col("fp")))
                              .alias("average_precision"))


def brier(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """E6."""
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def class_report(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class precision/recall/F1/support, then accuracy, macro and weighted averages."""
    conf = confusion(df, y, pred, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def cls(name, t_p, f_p, f_n, support):
        pr, rc = zero_div(t_p, t_p + f_p), zero_div(t_p, t_p + f_n)
        return F.struct(F.lit(name).alias("label"), pr.alias("precision"), rc.alias("recall"),
                        zero_div(F.lit(2.0) * pr * rc, pr + rc).alias("f1"), support.cast("long").alias("support"))

    per = conf.select(*by, F.explode(F.array(cls("0", tn, fn, fp, tn + fp), cls("1", tp, fp, fn, tp + fn)))
                      .alias("r")).select(*by, "r.*")
    tot = per.groupBy(*by).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        safe_div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        safe_div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"),
        F.sum("support").alias("n"))
    acc = conf.select(*by, zero_div(tp + tn, tn + fp + fn + tp).alias("acc"))
    summ = _attach(tot, acc, by)
    extra = summ.select(*by, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.col("acc").alias("precision"), F.col("acc").alias("recall"),
                 F.col("acc").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").alias("support")))).alias("r")).select(*by, "r.*")
    return per.unionByName(extra)


def pr_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = (), end_point: bool = True) -> DataFrame:
    """E10 + E11: precision, recall and F1 at every distinct threshold (ascending), plus the
    end point (precision 1, recall 0, no threshold)."""
    c = _curve_base(df, y, p, by)
    curve = c.select(*by, F.col("score").alias("threshold"),
                     zero_div("tp", F.col("tp") + F.col("fp")).alias("precision"),
                     F.when(F.col("P") == 0, F.lit(1.0)).otherwise(safe_div("tp", "P")).alias("recall"))
    if end_point:
        ends = c.groupBy(*by).agg(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                                  F.lit(0.0).alias("recall"))
        curve = curve.unionByName(ends)
    return curve.withColumn("f1", F.lit(2.0) * F.col("precision") * F.col("recall")
                            / (F.col("precision") + F.col("recall") + F.lit(F1_EPS)))


def choose_thresholds(curve: DataFrame, by: Sequence[str] = (), min_p: float = TARGET_P,
                      min_r: float = TARGET_R) -> DataFrame:
    """Max F1; best F1 with P >= min_p and R >= min_r (else the closest point,
    achievable = false); R >= min_r with max precision; P >= min_p with max recall.
    Ties go to the lowest threshold.  The end point of the curve is never chosen.  One aggregate over the curve:
    each strategy is the least of its own order among the points that qualify."""
    thr, point = F.col("threshold"), F.struct("threshold", "precision", "recall", "f1")
    p_ok, r_ok = F.col("precision") >= min_p, F.col("recall") >= min_r
    by_f1 = F.struct((-F.col("f1")).alias("a"), thr.alias("b"))
    dist = F.abs(F.col("precision") - F.lit(min_p)) + F.abs(F.col("recall") - F.lit(min_r))
    orders = {"max_f1": by_f1, "target": F.when(p_ok & r_ok, by_f1), "closest": F.struct(dist.alias("a"), thr.alias("b")),
              "recall_target": F.when(r_ok, F.struct((-F.col("precision")).alias("a"), thr.alias("b"))),
              "precision_target": F.when(p_ok, F.struct((-F.col("recall")).alias("a"), thr.alias("b")))}
    best = curve.where(thr.isNotNull()).groupBy(*by).agg(*[F.min_by(point, o).alias(f"_{k}") for k, o in orders.items()])
    picks = [("max_f1", F.col("_max_f1"), F.lit(None).cast("boolean")),
             ("target", F.coalesce("_target", "_closest"), F.col("_target").isNotNull()),
             ("recall_target", F.col("_recall_target"), F.lit(None).cast("boolean")),
             ("precision_target", F.col("_precision_target"), F.lit(None).cast("boolean"))]
    rows = F.array(*[F.struct(F.lit(k).alias("strategy"), c.alias("_t"), a.alias("achievable")) for k, c, a in picks])
    long = best.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*").where(F.col("_t").isNotNull())
    return long.select(*by, "strategy", "_t.*", "achievable")


def compare_thresholds(df: DataFrame, y: str, p: str, thresholds: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Confusion and rates at several thresholds in one pass (decision p >= t), long form,
    with the differences to the first threshold."""
    aggs = []
    for i, (name, t) in enumerate(thresholds.items()):
        hit = F.col(p) >= F.lit(float(t))
        yy = F.col(y) == 1
        aggs += [F.count(F.when(~yy & ~hit, 1)).alias(f"tn_{i}"), F.count(F.when(~yy & hit, 1)).alias(f"fp_{i}"),
                 F.count(F.when(yy & ~hit, 1)).alias(f"fn_{i}"), F.count(F.when(yy & hit, 1)).alias(f"tp_{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    parts = [F.struct(F.lit(name).alias("name"), F.lit(float(t)).alias("threshold"), F.col(f"tn_{i}").alias("tn"),
                      F.col(f"fp_{i}").alias("fp"), F.col(f"fn_{i}").alias("fn"), F.col(f"tp_{i}").alias("tp"))
             for i, (name, t) in enumerate(thresholds.items())]
    long = rates(wide.select(*by, F.explode(F.array(*parts)).alias("r")).select(*by, "r.*"))
    first = list(thresholds)[0]
    base = long.where(F.col("name") == first).select(*by, *[F.col(m).alias(f"_b_{m}") for m in
                                                            ("precision", "recall", "f1", "fp", "fn")])
    j = _attach(long, base, by)
    return j.select(*long.columns, *[(F.col(m) - F.col(f"_b_{m}")).alias(f"d_{m}") for m in
                                     ("precision", "recall", "f1", "fp", "fn")])


def score_summary(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Min, max, mean and (exact) median of the scores."""
    base = df.groupBy(*by).agg(F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"))
    med = exact_quantiles(df, [p], [0.5], keys=by).withColumnRenamed(f"{p}_q0", "median")
    return _attach(base, med, by)


def model_table(df: DataFrame, y: str, models: Sequence[str], baseline: str, t: float = 0.5,
                by: Sequence[str] = ()) -> DataFrame:
    """Per model AUC, AP, Brier and P/R/F1 at ``t``; improvement over ``baseline``.  One curve (distinct scores of all
    models with their counts) and one aggregate over it give all six."""
    keys = [*by, "model"]
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models])
    c = _curve_base(df.select(*by, y, F.explode(cells).alias("m")).select(*by, y, "m.*"), y, "p", keys)
    s, pos, neg, hit = (F.col(x) for x in ("score", "pos", "neg", "_hit"))
    one = c.withColumn("_hit", s >= F.lit(float(t))).groupBy(*keys).agg(
        safe_div(F.sum(pos * (F.col("neg_below") + neg / 2.0)), F.first("P") * F.first("N")).alias("auc"),
        F.sum(safe_div("pos", "P") * safe_div("tp", F.col("tp") + F.col("fp"))).alias("average_precision"),
        safe_div(F.sum(pos * F.pow(s - 1, 2) + neg * F.pow(s, 2)), F.sum(pos + neg)).alias("brier"),
        F.sum(F.when(~hit, neg).otherwise(0)).alias("tn"), F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, pos).otherwise(0)).alias("fn"), F.sum(F.when(hit, pos).otherwise(0)).alias("tp"))
    tab = rates(one).select(*keys, "auc", "average_precision", "brier", "precision", "recall", "f1")
    base = tab.where(F.col("model") == baseline).select(*by, F.col("auc").alias("_ba"), F.col("f1").alias("_bf"))
    j = _attach(tab, base, by)
    return j.select(*tab.columns, (F.col("auc") - F.col("_ba")).alias("auc_gain"),
                    (F.col("f1") - F.col("_bf")).alias("f1_gain"))


def generalisation(aucs: DataFrame, split: str = "split", first: str = "validation", second: str = "test") -> DataFrame:
    """AUC of two splits, the drop and its verdict."""
    piv = aucs.groupBy().pivot(split, [first, second]).agg(F.first("auc"))
    drop = F.col(first) - F.col(second)
    verdict = None
    for lim, name in AUC_DROP_LIMITS:
        cond = F.abs(drop) < F.lit(lim)
        verdict = F.when(cond, F.lit(name)) if verdict is None else verdict.when(cond, F.lit(name))
    return piv.select(F.col(first).alias(f"{first}_auc"), F.col(second).alias(f"{second}_auc"),
                      drop.alias("auc_drop"), verdict.otherwise(F.lit(AUC_DROP_ELSE)).alias("verdict"))


def split_difference(metrics: DataFrame, split: str = "split", first: str = "validation",
                     second: str = "test") -> DataFrame:
    """Per metric the values of two splits and the difference (unpivot + pivot)."""
    cols = [c for c in metrics.columns if c != split]
    long = metrics.unpivot([split], cols, "metric", "value")
    piv = long.groupBy("metric").pivot(split, [first, second]).agg(F.first("value"))
    return piv.withColumn("difference", F.col(second) - F.col(first))


def expected_check(actual: DataFrame, expected: Mapping[str, float] = EXPECTED_PRIMARY,
                   tol: float = EXPECTED_TOLERANCE) -> DataFrame:
    """Actual metric within ``tol`` of the expected value (expected values are a small
    literal table joined by metric name)."""
    spark = actual.sparkSession
    exp = spark.createDataFrame([(k, float(v)) for k, v in expected.items()], "metric string, expected double")
    long = actual.unpivot([], [c for c in actual.columns if c in expected], "metric", "actual")
    j = long.join(F.broadcast(exp), on="metric")
    return j.withColumns({"difference": F.col("actual") - F.col("expected"),
                          "within": (F.abs(F.col("actual") - F.col("expected")) < F.lit(tol)).cast("int")})


def class_balance(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives and positive rate."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(y)).cast("long").alias("positives"),
                               F.avg(F.col(y).cast("double")).alias("rate"))
