"""Registered queries over the scored view of ``lineitem``: metrics, thresholds, alerts, blends, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alerts as AL
from ..functions.columns import normalize
from ..operators import alerts as A
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import scale as N
from ..operators import splits as T
from . import fixtures as FX
from . import oracle as O
from .catalog import register

Y, P = "y2", "blend"
BY = ["split"]
PRIMARY = AL.THRESHOLD_PROFILES["PRIMARY"]
BLEND_W = MD.normalise({"p1": 0.408, "p2": 0.402, "p3": 0.19})
num = O.num


def sv(spark, sf_dir):
    return FX.scored_view(FX.table(spark, sf_dir, "lineitem"))


SV_CTE = f"""sv AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, p1, p2, p3,
         {O.rnd(f'{num(0.2)} * p1 + {num(0.5)} * p2 + {num(0.3)} * p3', 6)} AS blend,
         CASE WHEN p2 + {num(0.3)} * p1 > {num(0.8)} THEN 1 ELSE 0 END AS y2,
         CASE WHEN year(l_shipdate) <= 1998 THEN 'train' WHEN year(l_shipdate) = 1999 THEN 'validation'
              ELSE 'test' END AS split
  FROM (SELECT *, {O.rnd(f'l_discount * {num(10)}', 4)} AS p1,
               {O.rnd(f'(l_extendedprice % {num(1000)}) / {num(1000)}', 4)} AS p2,
               {O.rnd(f'l_quantity / {num(50)}', 4)} AS p3 FROM lineitem) AS li)"""


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join([SV_CTE, *ctes]) + "\n"


def zdiv(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN {num(0)} ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def ndiv(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def rates_sql(src: str, keys: str) -> str:
    prec = zdiv("tp", "tp + fp")
    rec = zdiv("tp", "tp + fn")
    return (f"SELECT {keys}, tn, fp, fn, tp, {zdiv('tp + tn', 'tn + fp + fn + tp')} AS accuracy, "
            f"{prec} AS precision, {rec} AS recall, "
            f"{zdiv(f'{num(2)} * {prec} * {rec}', f'{prec} + {rec}')} AS f1, "
            f"{ndiv('fp', 'tn + fp')} AS false_alarm_rate, {ndiv('tp', 'fn + tp')} AS detection_rate FROM {src}")


RATES_SPEC = ("tn:i fp:i fn:i tp:i accuracy:d precision:d recall:d f1:d false_alarm_rate:d detection_rate:d")

CONF_05 = ("SELECT split, count(*) FILTER (WHERE y2 = 0 AND NOT blend >= 0.5) AS tn, "
           "count(*) FILTER (WHERE y2 = 0 AND blend >= 0.5) AS fp, "
           "count(*) FILTER (WHERE y2 = 1 AND NOT blend >= 0.5) AS fn, "
           "count(*) FILTER (WHERE y2 = 1 AND blend >= 0.5) AS tp FROM sv GROUP BY split")

CURVE = """sc AS (SELECT split, CAST(blend AS DOUBLE) AS score, CAST(sum(y2) AS BIGINT) AS pos,
              CAST(count(*) - sum(y2) AS BIGINT) AS neg FROM sv GROUP BY split, blend),
cb AS (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
              sum(neg) OVER (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
              coalesce(sum(neg) OVER (PARTITION BY split ORDER BY score
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
              sum(pos) OVER (PARTITION BY split) AS "P", sum(neg) OVER (PARTITION BY split) AS "N" FROM sc)"""

PR = f"""pr AS (SELECT split, score AS threshold, {zdiv('tp', 'tp + fp')} AS precision,
              CASE WHEN "P" = 0 THEN {num(1)} ELSE CAST(tp AS DOUBLE) / "P" END AS recall FROM cb
            UNION ALL SELECT DISTINCT split, NULL, {num(1)}, {num(0)} FROM cb),
prf AS (SELECT *, {num(2)} * precision * recall / (precision + recall + {num(1e-10)}) AS f1 FROM pr)"""


def decided(spark, sf_dir, t=0.5):
    return sv(spark, sf_dir).withColumn("_d", AL.decide(P, t))


@register("e1_e2_e9_rates", O.norm(W() + rates_sql(f"({CONF_05})", "split"), "split:s " + RATES_SPEC))
def q_rates(spark, sf_dir):
    """E1, E2, E9 per split at 0.5."""
    return normalize(M.rates(M.confusion(decided(spark, sf_dir), Y, "_d", BY)))


@register("e3_auc", O.norm(W(CURVE) + ' SELECT split, sum(pos * (CAST(neg_below AS DOUBLE) + CAST(neg AS DOUBLE) / 2)) / (max("P") * max("N")) '
                           "AS auc FROM cb GROUP BY split", "split:s auc:d"))
def q_auc(spark, sf_dir):
    """E3 per split (ties exact)."""
    return normalize(M.auc(sv(spark, sf_dir), Y, P, BY))


@register("e4_roc_curve", O.norm(W(CURVE) + ' SELECT split, score AS threshold, CAST(fp AS DOUBLE) / "N" AS fpr, '
                                 'CAST(tp AS DOUBLE) / "P" AS tpr FROM cb UNION ALL SELECT DISTINCT split, NULL, 0.0, 0.0 '
                                 'FROM cb', "split:s threshold:d fpr:d tpr:d"))
def q_roc(spark, sf_dir):
    """E4 per split, start point included."""
    return normalize(M.roc_curve(sv(spark, sf_dir), Y, P, BY))


@register("e5_average_precision", O.norm(
    W(CURVE) + ' SELECT split, sum(CAST(pos AS DOUBLE) / "P" * (CAST(tp AS DOUBLE) / (tp + fp))) AS average_precision '
               "FROM cb GROUP BY split", "split:s average_precision:d"))
def q_ap(spark, sf_dir):
    """E5 per split."""
    return normalize(M.average_precision(sv(spark, sf_dir), Y, P, BY))


@register("e6_brier", O.norm(W() + " SELECT split, avg(pow(blend - y2, 2)) AS brier FROM sv GROUP BY split",
                             "split:s brier:d"))
def q_brier(spark, sf_dir):
    """E6 per split."""
    return normalize(M.brier(sv(spark, sf_dir), Y, P, BY))


def _class_sql() -> str:
    def cls(name, t_p, f_p, f_n, sup):
        pr, rc = zdiv(t_p, f"{t_p} + {f_p}"), zdiv(t_p, f"{t_p} + {f_n}")
        return (f"SELECT split, '{name}' AS label, {pr} AS precision, {rc} AS recall, "
                f"{zdiv(f'{num(2)} * {pr} * {rc}', f'{pr} + {rc}')} AS f1, {sup} AS support FROM conf")
    per = f"per AS ({cls('0', 'tn', 'fn', 'fp', 'tn + fp')} UNION ALL {cls('1', 'tp', 'fp', 'fn', 'tp + fn')})"
    tot = ("tot AS (SELECT split, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, "
           "sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr, "
           "sum(f1 * support) / sum(support) AS wf, sum(support) AS n FROM per GROUP BY split)")
    acc = f"acc AS (SELECT split, {zdiv('tp + tn', 'tn + fp + fn + tp')} AS a FROM conf)"
    body = ("SELECT * FROM per UNION ALL "
            "SELECT t.split, 'accuracy', a, a, a, n FROM tot t JOIN acc USING (split) UNION ALL "
            "SELECT split, 'macro avg', mp, mr, mf, n FROM tot UNION ALL "
            "SELECT split, 'weighted avg', wp, wr, wf, n FROM tot")
    return O.norm(W(f"conf AS ({CONF_05})", per, tot, acc) + body,
                  "split:s label:s precision:d recall:d f1:d support:i")


@register("e8_class_report", _class_sql())
def q_class_report(spark, sf_dir):
    """E8 per split at 0.5."""
    return normalize(M.class_report(decided(spark, sf_dir), Y, "_d", BY))


@register("e10_e11_pr_curve", O.norm(W(CURVE, PR) + " SELECT * FROM prf",
                                     "split:s threshold:d precision:d recall:d f1:d"))
def q_pr(spark, sf_dir):
    """E10 + E11 per split, with the end point."""
    return normalize(M.pr_curve(sv(spark, sf_dir), Y, P, BY))


def _choose_sql(label: str = "y2") -> str:
    cur = "cur AS (SELECT * FROM prf WHERE threshold IS NOT NULL)"

    def top(src, order, name, ach):
        return (f"SELECT split, '{name}' AS strategy, threshold, precision, recall, f1, {ach} AS achievable FROM "
                f"(SELECT *, row_number() OVER (PARTITION BY split ORDER BY {order}) AS rk FROM ({src})) WHERE rk = 1")
    both = "SELECT * FROM cur WHERE precision >= 0.7 AND recall >= 0.7"
    dist = "abs(precision - 0.7) + abs(recall - 0.7)"
    parts = [
        top("SELECT * FROM cur", "f1 DESC, threshold", "max_f1", "NULL"),
        top(both, "f1 DESC, threshold", "target", "true"),
        top(f"SELECT * FROM cur WHERE split NOT IN (SELECT split FROM ({both}))", f"{dist}, threshold", "target",
            "false"),
        top("SELECT * FROM cur WHERE recall >= 0.7", "precision DESC, threshold", "recall_target", "NULL"),
        top("SELECT * FROM cur WHERE precision >= 0.7", "recall DESC, threshold", "precision_target", "NULL"),
    ]
    return O.norm(W(CURVE.replace("y2", label), PR, cur) + " UNION ALL ".join(parts),
                  "split:s strategy:s threshold:d precision:d recall:d f1:d achievable:s")


@register("e12_e16_thresholds", _choose_sql())
def q_choose(spark, sf_dir):
    """E12-E16 per split (ties -> lowest threshold; end point excluded)."""
    out = M.choose_thresholds(M.pr_curve(sv(spark, sf_dir), Y, P, BY), BY)
    return normalize(out.withColumn("achievable", F.col("achievable").cast("string")))


@register("e14_closest_threshold", _choose_sql("y"))
def q_closest(spark, sf_dir):
    """E12-E16 where no threshold reaches both targets: the closest point, marked as not achievable."""
    out = M.choose_thresholds(M.pr_curve(sv(spark, sf_dir), "y", P, BY), BY)
    return normalize(out.withColumn("achievable", F.col("achievable").cast("string")))


def _compare_sql() -> str:
    def conf(name, t):
        return (f"SELECT split, '{name}' AS name, {num(t)} AS threshold, "
                f"count(*) FILTER (WHERE y2 = 0 AND NOT blend >= {num(t)}) AS tn, "
                f"count(*) FILTER (WHERE y2 = 0 AND blend >= {num(t)}) AS fp, "
                f"count(*) FILTER (WHERE y2 = 1 AND NOT blend >= {num(t)}) AS fn, "
                f"count(*) FILTER (WHERE y2 = 1 AND blend >= {num(t)}) AS tp FROM sv GROUP BY split")
    c = f"cc AS ({conf('DEFAULT', 0.5)} UNION ALL {conf('PRIMARY', PRIMARY)})"
    r = f"rr AS ({rates_sql('cc', 'split, name, threshold')})"
    body = ("SELECT a.*, a.precision - b.precision AS d_precision, a.recall - b.recall AS d_recall, "
            "a.f1 - b.f1 AS d_f1, a.fp - b.fp AS d_fp, a.fn - b.fn AS d_fn "
            "FROM rr a JOIN (SELECT * FROM rr WHERE name = 'DEFAULT') b USING (split)")
    return O.norm(W(c, r) + body, "split:s name:s threshold:d " + RATES_SPEC +
                  " d_precision:d d_recall:d d_f1:d d_fp:i d_fn:i")


@register("e17_threshold_compare", _compare_sql())
def q_compare(spark, sf_dir):
    """0.5 against the primary threshold, per split, one pass."""
    return normalize(M.compare_thresholds(sv(spark, sf_dir), Y, P, {"DEFAULT": 0.5, "PRIMARY": PRIMARY}, BY))


@register("e18_score_summary", O.norm(
    W() + " SELECT split, min(blend) AS min, max(blend) AS max, avg(blend) AS mean, "
          "quantile_cont(blend, 0.5) AS median FROM sv GROUP BY split", "split:s min:d max:d mean:d median:d"))
def q_summary(spark, sf_dir):
    """E18 per split (exact median)."""
    return normalize(M.score_summary(sv(spark, sf_dir), P, BY))


def _model_sql() -> str:
    long = ("lg AS (SELECT split, y2, m.model AS model, m.p AS p FROM (SELECT split, y2, "
            "unnest([{'model': 'p1', 'p': p1}, {'model': 'p2', 'p': p2}, {'model': 'p3', 'p': p3}, "
            "{'model': 'blend', 'p': blend}]) AS m FROM sv) AS u)")
    sc = ("msc AS (SELECT split, model, CAST(p AS DOUBLE) AS score, CAST(sum(y2) AS BIGINT) AS pos, "
          "CAST(count(*) - sum(y2) AS BIGINT) AS neg FROM lg GROUP BY split, model, p)")
    cb = ('mcb AS (SELECT *, sum(pos) OVER (PARTITION BY split, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, '
          'sum(neg) OVER (PARTITION BY split, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp, '
          'coalesce(sum(neg) OVER (PARTITION BY split, model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING '
          'AND 1 PRECEDING), 0) AS neg_below, sum(pos) OVER (PARTITION BY split, model) AS "P", '
          'sum(neg) OVER (PARTITION BY split, model) AS "N" FROM msc)')
    agg = ('ma AS (SELECT split, model, sum(pos * (CAST(neg_below AS DOUBLE) + CAST(neg AS DOUBLE) / 2)) / (max("P") * max("N")) AS auc, '
           'sum(CAST(pos AS DOUBLE) / "P" * (CAST(tp AS DOUBLE) / (tp + fp))) AS average_precision FROM mcb '
           'GROUP BY split, model)')
    br = "mb AS (SELECT split, model, avg(pow(p - y2, 2)) AS brier FROM lg GROUP BY split, model)"
    cf = ("mc AS (SELECT split, model, count(*) FILTER (WHERE y2 = 0 AND NOT p >= 0.5) AS tn, "
          "count(*) FILTER (WHERE y2 = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y2 = 1 AND NOT p >= 0.5) AS fn, "
          "count(*) FILTER (WHERE y2 = 1 AND p >= 0.5) AS tp FROM lg GROUP BY split, model)")
    mr = f"mr AS ({rates_sql('mc', 'split, model')})"
    tab = ("tab AS (SELECT ma.*, mb.brier, mr.precision, mr.recall, mr.f1 FROM ma JOIN mb USING (split, model) "
           "JOIN mr USING (split, model))")
    body = ("SELECT t.*, t.auc - b.auc AS auc_gain, t.f1 - b.f1 AS f1_gain FROM tab t "
            "JOIN (SELECT * FROM tab WHERE model = 'p1') b USING (split)")
    return O.norm(W(long, sc, cb, agg, br, cf, mr, tab) + body,
                  "split:s model:s auc:d average_precision:d brier:d precision:d recall:d f1:d auc_gain:d f1_gain:d")


@register("e19_model_table", _model_sql())
def q_model_table(spark, sf_dir):
    """Members and blend per split, improvement over p1."""
    return normalize(M.model_table(sv(spark, sf_dir), Y, ["p1", "p2", "p3", "blend"], "p1", 0.5, BY))


@register("e20_generalisation", O.norm(
    W(CURVE, 'au AS (SELECT split, sum(pos * (CAST(neg_below AS DOUBLE) + CAST(neg AS DOUBLE) / 2)) / (max("P") * max("N")) AS auc FROM cb '
             'GROUP BY split)')
    + " SELECT v.auc AS validation_auc, t.auc AS test_auc, v.auc - t.auc AS auc_drop, "
      "CASE WHEN abs(v.auc - t.auc) < 0.02 THEN 'EXCELLENT' WHEN abs(v.auc - t.auc) < 0.05 THEN 'GOOD' "
      "ELSE 'WARNING' END AS verdict FROM au v, au t WHERE v.split = 'validation' AND t.split = 'test'",
    "validation_auc:d test_auc:d auc_drop:d verdict:s"))
def q_generalisation(spark, sf_dir):
    """E20."""
    return normalize(M.generalisation(M.auc(sv(spark, sf_dir), Y, P, BY)))


@register("e21_split_difference", O.norm(
    W(f"conf AS ({CONF_05})", f"r AS ({rates_sql('conf', 'split')})",
      "lg AS (SELECT split, metric, value FROM (SELECT split, accuracy, precision, recall, f1 FROM r) "
      "UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1)))")
    + " SELECT v.metric, v.value AS validation, t.value AS test, t.value - v.value AS difference "
      "FROM lg v JOIN lg t ON v.metric = t.metric AND v.split = 'validation' AND t.split = 'test'",
    "metric:s validation:d test:d difference:d"))
def q_split_difference(spark, sf_dir):
    """Validation vs test metrics."""
    r = M.rates(M.confusion(decided(spark, sf_dir), Y, "_d", BY)).select("split", "accuracy", "precision",
                                                                         "recall", "f1")
    return normalize(M.split_difference(r))


@register("e22_expected_check", O.norm(
    W("conf AS (SELECT count(*) FILTER (WHERE y2 = 0 AND NOT blend >= 0.309059) AS tn, "
      "count(*) FILTER (WHERE y2 = 0 AND blend >= 0.309059) AS fp, "
      "count(*) FILTER (WHERE y2 = 1 AND NOT blend >= 0.309059) AS fn, "
      "count(*) FILTER (WHERE y2 = 1 AND blend >= 0.309059) AS tp FROM sv WHERE split = 'test')",
      f"r AS ({rates_sql('conf', '1 AS one')})",
      f"ex AS (SELECT * FROM (VALUES ('precision', {num(0.6180)}), ('recall', {num(0.7001)}), "
      f"('f1_score', {num(0.6565)})) AS e(metric, expected))",
      "lg AS (SELECT 'precision' AS metric, precision AS actual FROM r UNION ALL "
      "SELECT 'recall', recall FROM r UNION ALL SELECT 'f1_score', f1 FROM r)")
    + " SELECT metric, actual, CAST(expected AS DOUBLE) AS expected, actual - expected AS difference, "
      "CASE WHEN abs(actual - expected) < 0.05 THEN 1 ELSE 0 END AS within FROM lg JOIN ex USING (metric)",
    "metric:s actual:d expected:d difference:d within:i"))
def q_expected(spark, sf_dir):
    """Test metrics at the primary threshold against the expected production values."""
    t = sv(spark, sf_dir).where(F.col("split") == "test").withColumn("_d", AL.decide(P, PRIMARY))
    r = M.rates(M.confusion(t, Y, "_d")).select("precision", "recall", F.col("f1").alias("f1_score"))
    return normalize(M.expected_check(r))


@register("e23_class_balance", O.norm(
    W() + " SELECT split, count(*) AS rows, sum(y2) AS positives, avg(y2) AS rate FROM sv GROUP BY split",
    "split:s rows:i positives:i rate:d"))
def q_balance(spark, sf_dir):
    """E23."""
    return normalize(M.class_balance(sv(spark, sf_dir), Y, BY))


LEVELS_SQL = ("CASE WHEN blend >= 0.8 THEN 'CRITICAL' WHEN blend >= 0.6 THEN 'HIGH' WHEN blend >= 0.4 THEN 'MODERATE' "
              "WHEN blend >= 0.31 THEN 'LOW' WHEN blend >= 0.2 THEN 'WATCH' ELSE 'NONE' END")
CONF_SQL = ("CASE WHEN abs(blend - 0.309059) > 0.2 THEN 'HIGH' WHEN abs(blend - 0.309059) > 0.1 THEN 'MODERATE' "
            "ELSE 'LOW' END")


@register("a5_a8_predict_batch", O.norm(
    W() + f" SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, blend AS storm_probability, "
          f"{LEVELS_SQL} AS alert_level, CASE WHEN blend >= 0.309059 THEN 'STORM' ELSE 'NO STORM' END AS prediction, "
          f"{CONF_SQL} AS confidence FROM sv",
    "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i storm_probability:d alert_level:s prediction:s confidence:s"))
def q_predict(spark, sf_dir):
    """Batch output with keys."""
    return normalize(A.predict_batch(sv(spark, sf_dir), P, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]))


@register("a9_predict_detail", O.norm(
    W() + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, blend AS storm_probability, "
          f"{LEVELS_SQL} AS alert_level, CASE WHEN blend >= 0.309059 THEN 'STORM' ELSE 'NO STORM' END AS prediction, "
          f"{CONF_SQL} AS confidence, l_shipdate AS timestamp, CAST(round_even(CAST(blend AS DECIMAL(18, 6)), 4) AS DOUBLE) AS probability_rounded, "
          "0.309059 AS threshold, 'stormcell-0.1' AS model_version FROM sv",
    "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i storm_probability:d alert_level:s prediction:s "
    "confidence:s timestamp:t probability_rounded:d threshold:d model_version:s"))
def q_detail(spark, sf_dir):
    """Detailed output (time, half-even rounded probability, threshold, version)."""
    return normalize(A.predict_batch(sv(spark, sf_dir), P, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                                     detail=True, ts="l_shipdate"))


@register("a4_profiles", O.norm(
    W() + " SELECT split, p.profile, p.threshold, count(*) FILTER (WHERE blend >= p.threshold) AS alerts, "
          f"count(*) AS rows FROM sv, (VALUES ('PRIMARY', {num(0.309059)}), ('SECONDARY', {num(0.455839)}), "
          f"('DEFAULT', {num(0.5)})) "
          "AS p(profile, threshold) GROUP BY split, p.profile, p.threshold",
    "split:s profile:s threshold:d alerts:i rows:i"))
def q_profiles(spark, sf_dir):
    """A4: three threshold profiles at once, decisions counted per split."""
    d = A.decide_profiles(sv(spark, sf_dir), P)
    return normalize(d.groupBy("split", "profile", "threshold").agg(F.sum("decision").cast("long").alias("alerts"),
                                                                    F.count(F.lit(1)).alias("rows")))


@register("a10_alert_distribution", O.norm(
    W("lv AS (SELECT * FROM (VALUES ('CRITICAL'), ('HIGH'), ('MODERATE'), ('LOW'), ('WATCH'), ('NONE')) AS l(alert_level))",
      f"cnt AS (SELECT split, {LEVELS_SQL} AS alert_level, count(*) AS c FROM sv GROUP BY ALL)",
      "tot AS (SELECT split, count(*) AS n FROM sv GROUP BY split)")
    + " SELECT t.split, lv.alert_level, coalesce(c, 0) AS count, CAST(coalesce(c, 0) AS DOUBLE) / n * 100 AS percent "
      "FROM tot t CROSS JOIN lv LEFT JOIN cnt ON cnt.split = t.split AND cnt.alert_level = lv.alert_level",
    "split:s alert_level:s count:i percent:d"))
def q_alert_dist(spark, sf_dir):
    """A10: six levels per split, zeros included."""
    return normalize(A.alert_distribution(sv(spark, sf_dir), P, BY))


@register("a11_first_events", O.norm(
    W() + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p1, p2, p3, l_shipdate, blend AS storm_probability, "
          f"{LEVELS_SQL} AS alert_level, CASE WHEN blend >= 0.309059 THEN 1 ELSE 0 END AS detected FROM sv "
          "WHERE y2 = 1 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, p1, p2, p3 LIMIT 10",
    "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i p1:d p2:d p3:d l_shipdate:t storm_probability:d "
    "alert_level:s detected:i"))
def q_first_events(spark, sf_dir):
    """First ten actual events (a top-k report)."""
    return normalize(A.first_events(sv(spark, sf_dir), Y, P, "l_shipdate", 10,
                                    keys=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p1", "p2", "p3"]))


@register("m3_m4_m5_blends", O.norm(
    W() + f" SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
          f"{num(BLEND_W['p1'])} * p1 + {num(BLEND_W['p2'])} * p2 + {num(BLEND_W['p3'])} * p3 AS weighted, "
          f"(0.0 + p1 + p2 + p3) / 3.0 AS mean_score FROM sv",
    "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i weighted:d mean_score:d"))
def q_blends(spark, sf_dir):
    """M3 (weights normalised), M4 (weighted blend), M5 (plain mean) on the members p1-p3."""
    d = MD.blend(sv(spark, sf_dir), {"p1": 0.408, "p2": 0.402, "p3": 0.19}, "weighted")
    d = MD.mean_blend(d, ["p1", "p2", "p3"])
    return normalize(d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "weighted", "mean_score"))


def _trials():
    return MD.trial_weights(MD.SEARCH_TRIALS, 3, 7)


def _search_sql() -> str:
    vals = ", ".join(f"({i}, {num(a)}, {num(b)}, {num(c)})" for i, (a, b, c) in enumerate(_trials()))
    mix = "(w0 * p1 + w1 * p2 + w2 * p3) / (w0 + w1 + w2)"
    body = (f"SELECT trial, tp, fp, fn, {zdiv('2.0 * tp', '2.0 * tp + fp + fn')} AS f1, w0, w1, w2 FROM ("
            f"SELECT trial, w0, w1, w2, count(*) FILTER (WHERE y2 = 1 AND {mix} >= 0.5) AS tp, "
            f"count(*) FILTER (WHERE y2 = 0 AND {mix} >= 0.5) AS fp, "
            f"count(*) FILTER (WHERE y2 = 1 AND NOT {mix} >= 0.5) AS fn "
            f"FROM sv, (VALUES {vals}) AS t(trial, w0, w1, w2) WHERE split = 'validation' "
            f"GROUP BY trial, w0, w1, w2)")
    return O.norm(W() + body, "trial:i tp:i fp:i fn:i f1:d w0:d w1:d w2:d")


@register("m7_weight_search", _search_sql())
def q_search(spark, sf_dir):
    """M7: validation F1 at 0.5 of 100 seeded weight trials, one job."""
    val = sv(spark, sf_dir).where(F.col("split") == "validation")
    return normalize(MD.search_weights(val, ["p1", "p2", "p3"], Y, _trials()))


def _flow_sql() -> str:
    vals = ", ".join(f"({i}, {num(a)}, {num(b)}, {num(c)})" for i, (a, b, c) in enumerate(_trials()))
    mix = "(w0 * p1 + w1 * p2 + w2 * p3) / (w0 + w1 + w2)"
    f1 = zdiv("2.0 * tp", "2.0 * tp + fp + fn")
    return O.norm(W(
        f"tr AS (SELECT trial, w0, w1, w2, count(*) FILTER (WHERE y2 = 1 AND {mix} >= 0.5) AS tp, "
        f"count(*) FILTER (WHERE y2 = 0 AND {mix} >= 0.5) AS fp, count(*) FILTER (WHERE y2 = 1 AND NOT {mix} >= 0.5) AS fn "
        f"FROM sv, (VALUES {vals}) AS t(trial, w0, w1, w2) WHERE split = 'validation' GROUP BY trial, w0, w1, w2)",
        f"best AS (SELECT * FROM tr ORDER BY {f1} DESC, trial LIMIT 1)",
        "bl AS (SELECT split, y2, trial, " + O.rnd("w0 / (w0 + w1 + w2) * p1 + w1 / (w0 + w1 + w2) * p2 + "
                                                   "w2 / (w0 + w1 + w2) * p3", 6) + " AS s FROM sv CROSS JOIN best)",
        "cs AS (SELECT s, count(*) FILTER (WHERE y2 = 1) AS pos, count(*) FILTER (WHERE y2 = 0) AS neg FROM bl "
        "WHERE split = 'validation' GROUP BY s)",
        "cu AS (SELECT s, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, "
        "sum(pos) OVER () AS allpos FROM cs)",
        f"cf AS (SELECT s, {zdiv('tp', 'tp + fp')} AS pr, {zdiv('tp', 'allpos')} AS rc FROM cu)",
        f"th AS (SELECT s AS threshold FROM cf ORDER BY {zdiv('2.0 * pr * rc', 'pr + rc')} DESC, s LIMIT 1)")
        + " SELECT split, trial, threshold, count(*) FILTER (WHERE y2 = 0 AND s < threshold) AS tn, "
          "count(*) FILTER (WHERE y2 = 0 AND s >= threshold) AS fp, count(*) FILTER (WHERE y2 = 1 AND s < threshold) AS fn, "
          "count(*) FILTER (WHERE y2 = 1 AND s >= threshold) AS tp FROM bl CROSS JOIN th GROUP BY split, trial, threshold",
        "split:s trial:i threshold:d tn:i fp:i fn:i tp:i")


@register("m7_blend_flow", _flow_sql())
def q_blend_flow(spark, sf_dir):
    """Weights searched on validation, applied, threshold chosen on validation, all splits scored."""
    d = sv(spark, sf_dir).select("p1", "p2", "p3", Y, "split")
    return normalize(MD.blend_flow(d, ["p1", "p2", "p3"], Y, "split", _trials())[0]
                     .select("split", "trial", "threshold", "tn", "fp", "fn", "tp"))


@register("m13_row_mean", O.norm(
    W() + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
          "coalesce((0.0 + p1 + p2 + p3 + blend + y2) / 5.0, 0.0) AS row_mean FROM sv",
    "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i row_mean:d"))
def q_row_mean(spark, sf_dir):
    """Mean of the first five columns."""
    d = MD.row_mean(sv(spark, sf_dir), ["p1", "p2", "p3", "blend", "y2"])
    return normalize(d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "row_mean"))


SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _robust_sql() -> str:
    q = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_r"
                  for c in SCALE_COLS)
    cols = ", ".join(f"({c} - {c}_m) / (CASE WHEN {c}_r = 0 THEN 1.0 ELSE {c}_r END) AS {c}" for c in SCALE_COLS)
    body = (f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {cols} FROM lineitem, "
            f"(SELECT {q} FROM lineitem WHERE year(l_shipdate) <= 1998) AS st")
    return O.norm("WITH x AS (SELECT 1) " + body,
                  "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i " + " ".join(f"{c}:d" for c in SCALE_COLS))


@register("n1_robust_scale", _robust_sql())
def q_robust(spark, sf_dir):
    """Robust scaling fit on the train years (exact quartiles), applied to all rows."""
    li = FX.table(spark, sf_dir, "lineitem")
    stats = N.fit_robust(li.where(T.split_range("train", "l_shipdate", 1998, 1999)), SCALE_COLS)
    out = N.apply_robust(li, stats, SCALE_COLS)
    return normalize(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *SCALE_COLS))


@register("n2_n3_class_weights", O.norm(
    W() + " SELECT split, y2 AS class, count(*) AS count, least(CAST(n AS DOUBLE) / (k * count(*)), 10.0) AS weight FROM sv "
          "JOIN (SELECT split, count(*) AS n, count(DISTINCT y2) AS k FROM sv GROUP BY split) USING (split) "
          "GROUP BY split, y2, n, k", "split:s class:i count:i weight:d"))
def q_weights(spark, sf_dir):
    """N2 + N3: balanced class weights per split, capped at 10."""
    return normalize(N.class_weights(sv(spark, sf_dir), Y, cap=10.0, by=BY))
