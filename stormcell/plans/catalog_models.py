"""Registered model and streaming queries.  Fitted scores have no SQL oracle (rows-only check; facts that any right fit meets have one);
streams compare with SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import normalize
from ..operators import labels as LB
from ..operators import models as MD
from ..operators import scale as N
from ..operators.series import Series
from ..streaming import streams as X
from . import fixtures as FX
from . import oracle as O
from .catalog import DEMO_BLOCK_ROWS, cleaned, register
from .catalog_eval import LEVELS_SQL, W as SVW
from .catalog_series import P, SPLIT_SQL

# The 13 raw inputs of the production blend (Year, Day, Hour and ten channels)
MODEL_FEATURES = ["Year", "Day", "Hour", "IMF_Magnitude", "IMF_Bz", "IMF_By", "IMF_Bx", "Proton_Temp",
                  "Proton_Density", "Flow_Speed", "Flow_Pressure", "Dst_index", "AE_index"]


def prepared(spark, sf_dir):
    """N4 on the corrected series: split by day, fill per split, robust scaling fit on train, weights."""
    c = LB.kp_labels(cleaned(spark, sf_dir)).withColumn("split", FX.panel_split())
    c = c.select("ts", "seq", "split", *MODEL_FEATURES, "Storm", "Kp_index", "Kp_actual", "Moderate_Storm")
    c = c.withColumns({f: F.col(f).cast("double") for f in MODEL_FEATURES})
    s = Series(order=("ts", "seq"), block_rows=DEMO_BLOCK_ROWS)
    scaled, feats, _stats, weights = N.prepare(c, s, "split", "Storm", cap=10.0)
    return scaled, feats, weights


def _prepare_sql() -> str:
    """N4 in SQL: fills per split, quartiles of the filled train rows, class weights of the train rows."""
    def fill(c):
        return (f"coalesce(CAST({c} AS DOUBLE), last_value(CAST({c} AS DOUBLE) IGNORE NULLS) OVER (PARTITION BY split ORDER BY ts "
                f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(CAST({c} AS DOUBLE) IGNORE NULLS) OVER "
                f"(PARTITION BY split ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0) AS {c}")
    feats = [f'"{c}"' for c in MODEL_FEATURES]
    q = ", ".join(f"quantile_cont({c}, 0.5) AS m{i}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS r{i}"
                  for i, c in enumerate(feats))
    out = ", ".join(f"({c} - m{i}) / (CASE WHEN r{i} = 0 THEN 1.0 ELSE r{i} END) AS {c}" for i, c in enumerate(feats))
    body = (P(f"lab AS (SELECT ts, {SPLIT_SQL} AS split, CASE WHEN Kp_index / 10.0 >= 5 THEN 1 ELSE 0 END AS Storm, "
              f"{', '.join(feats)} FROM cleaned)", f"fl AS (SELECT ts, split, Storm, {', '.join(fill(c) for c in feats)} FROM lab)",
              f"st AS (SELECT {q} FROM fl WHERE split = 'train')",
              "wt AS (SELECT Storm AS class, least(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 10.0) AS weight "
              "FROM fl WHERE split = 'train' GROUP BY Storm)", clean=True)
            + f"SELECT ts, split, {out}, Storm, weight FROM fl CROSS JOIN st LEFT JOIN wt ON fl.Storm = wt.class")
    return O.norm(body, "ts:t split:s " + " ".join(f"{c}:d" for c in MODEL_FEATURES) + " Storm:i weight:d")


@register("n4_prepare", _prepare_sql())
def q_prepare(spark, sf_dir):
    """Filled, scaled, weighted training table."""
    scaled, feats, weights = prepared(spark, sf_dir)
    return normalize(N.with_weights(scaled, weights, "Storm").select("ts", "split", *feats, "Storm", "weight"))


def held():
    return F.col("split") == "validation"


BLEND = {"model_precision": 0.408, "model_recall": 0.402, "model_balanced": 0.190}


def member_scores(spark, sf_dir, **params):
    """(scored rows, members): the three members fitted with patience on train rows, judged on validation rows."""
    scaled, feats, weights = prepared(spark, sf_dir)
    data = MD.cut_lineage(N.with_weights(scaled, weights, "Storm"))
    members = MD.fit_members(data.where(F.col("split") != "test"), feats, "Storm", held(), weight="weight", **params)
    out = data
    for name, m in members.items():
        out = MD.score(out, m.model, name)
    return MD.blend(out, BLEND, "p"), members


@register("m1_m2_m4_gbt_blend")
def q_gbt(spark, sf_dir):
    """M1 + M2 + M4 + A2: three weighted boosted-tree members that stop 50 rounds after their best validation round (up to
    1000 rounds), blended scores on all rows."""
    out, members = member_scores(spark, sf_dir)
    return normalize(out.select("ts", "split", "Storm", *members, "p"))


@register("m2_m9_m12_invariants", O.norm(
    P("s AS (SELECT " + SPLIT_SQL + " AS split, count(*) AS n FROM cleaned GROUP BY 1)", clean=True)
    + "SELECT split AS subject, 'rows scored' AS fact, n AS value FROM s UNION ALL SELECT * FROM (VALUES "
      "('members', 'scores outside 0 and 1', 0), ('members', 'blends outside their members', 0), "
      "('members', 'stopped later than patience after the best round', 0), ('importance', 'features', 13), "
      "('importance', 'per mille in all', 1000), ('stacking', 'scores outside 0 and 1', 0), "
      "('stacking', 'inputs missing', 0)) AS t(subject, fact, value)", "subject:s fact:s value:i"))
def q_invariants(spark, sf_dir):
    """M2, M4, M9, M11 and M12 on short fits: facts that hold for any right fit, counted over all rows."""
    out, members = member_scores(spark, sf_dir, maxIter=20, patience=5)
    out = MD.cut_lineage(out)
    names = list(members)
    outside = F.greatest(*names) > 1, F.least(*names) < 0
    late = sum(m.ended > m.best + 5 or len(m.losses) > 20 for m in members.values())
    facts = out.agg(F.count(F.when(outside[0] | outside[1], 1)).alias("a"),
                    F.count(F.when((F.col("p") > F.greatest(*names) + 1e-9) | (F.col("p") < F.least(*names) - 1e-9), 1)).alias("b")).first()
    imp = MD.importance(members["model_balanced"].model, MODEL_FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("importance").alias("s")).first()
    s = Series(keys=("split",), order=("ts", "seq"), block_rows=DEMO_BLOCK_ROWS)
    meta = MD.meta_features(out.select("ts", "seq", "split", "Storm", "weight", "p", *MODEL_FEATURES[:2]), s, "p", MODEL_FEATURES[:2])
    cols = ["meta_p", "meta_conf", *[f"{c}_roll24" for c in MODEL_FEATURES[:2]]]
    meta = MD.cut_lineage(meta)
    lr = MD.fit_logistic(meta.where(F.col("split") == "train"), cols, "Storm", 1.0, "weight")
    stacked = MD.score(meta, lr, "pm").agg(F.count(F.when(~F.col("pm").between(0, 1), 1)).alias("a"),
                                           F.count(F.when(F.greatest(*[F.col(c).isNull() for c in cols]), 1)).alias("b")).first()
    rows = [("members", "scores outside 0 and 1", facts["a"]), ("members", "blends outside their members", facts["b"]),
            ("members", "stopped later than patience after the best round", late), ("importance", "features", imp["n"]),
            ("importance", "per mille in all", round(1000 * imp["s"])), ("stacking", "scores outside 0 and 1", stacked["a"]),
            ("stacking", "inputs missing", stacked["b"])]
    counted = out.groupBy(F.col("split").alias("subject")).agg(F.lit("rows scored").alias("fact"), F.count(F.lit(1)).alias("value"))
    return normalize(counted.unionByName(spark.createDataFrame(rows, "subject string, fact string, value long")))


@register("m9_importance")
def q_importance(spark, sf_dir):
    """M9: normalised feature importances of one boosted-tree model."""
    scaled, feats, _w = prepared(spark, sf_dir)
    fit_rows = scaled.where(F.col("split") != "test").withColumn("is_val", F.col("split") == "validation")
    m = MD.fit_gbt(fit_rows, feats, "Storm", validation="is_val")
    return normalize(MD.importance(m, feats))


@register("m8_param_search")
def q_param_search(spark, sf_dir):
    """M8: 20 settings by successive halving over boosting rounds, the last one to its early stop."""
    scaled, feats, weights = prepared(spark, sf_dir)
    data = N.with_weights(scaled, weights, "Storm").where(F.col("split") != "test")
    return normalize(MD.search_params(data, feats, "Storm", held(), MD.search_settings(), "weight"))


@register("m11_m12_stacking")
def q_stacking(spark, sf_dir):
    """M11 + M12: stacking inputs from a member score, balanced logistic regression on them."""
    scaled, feats, weights = prepared(spark, sf_dir)
    data = N.with_weights(scaled, weights, "Storm")
    fit_rows = data.where(F.col("split") != "test").withColumn("is_val", F.col("split") == "validation")
    m = MD.fit_gbt(fit_rows, feats, "Storm", validation="is_val")
    sc = MD.score(data, m, "p_gbt")
    s = Series(keys=("split",), order=("ts", "seq"), block_rows=DEMO_BLOCK_ROWS)
    meta = MD.meta_features(sc, s, "p_gbt", feats[:2])
    mcols = ["meta_p", "meta_conf", f"{feats[0]}_roll24", f"{feats[1]}_roll24"]
    lr = MD.fit_logistic(meta.where(F.col("split") == "train"), mcols, "Storm", 1.0, "weight")
    return normalize(MD.score(meta, lr, "p_meta").select("ts", "split", *mcols, "p_meta"))


# ------------------------------------------------------------------ streaming
@register("x1_stream_hourly_means", O.norm(
    "WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, avg(value) AS mean_value, "
    "count(*) AS events FROM events GROUP BY ALL) SELECT * FROM h",
    "hour:t event_type:s mean_value:d events:i"))
def q_stream_hourly(spark, sf_dir):
    """Event stream of four arrivals, 1-hour windows, 2-hour watermark, changed windows per batch merged by key."""
    ev = FX.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    src, out, ck = X.scratch(spark, "x1-in"), X.scratch(spark, "x1-out"), X.scratch(spark, "x1-ck")
    part = arrival(ev, 4)
    for k in range(4):  # each arrival is a batch, and a restart from the checkpoint
        X.arrive(ev, part, src, k)
        X.run_updates(X.hourly_means(X.read_stream(spark, src, X.EVENTS_SCHEMA), "2 hours"), out, ck)
    return normalize(X.latest(spark.read.parquet(out), ["hour", "event_type"]))


@register("x2_stream_alerts", O.norm(
    SVW() + f" SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, blend, {LEVELS_SQL} AS alert_level, "
    "CASE WHEN blend >= 0.309059 THEN 1 ELSE 0 END AS decision, CASE WHEN abs(blend - 0.309059) > 0.2 THEN 'HIGH' "
    "WHEN abs(blend - 0.309059) > 0.1 THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM sv",
    "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i blend:d alert_level:s decision:i confidence:s"))
def q_stream_alerts(spark, sf_dir):
    """Stateless scoring rules on a lineitem stream."""
    schema = FX.table(spark, sf_dir, "lineitem").schema
    li = X.read_stream(spark, sf_dir, schema, glob="lineitem.parquet")
    scored = X.score_stream(FX.scored_view(li), "blend")
    out, ck = X.scratch(spark, "x2-out"), X.scratch(spark, "x2-ck")
    X.run_available(scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "blend", "alert_level",
                                  "decision", "confidence"), out, ck)
    return normalize(spark.read.parquet(out))


@register("x3_stream_lag_features", O.norm(
    "SELECT event_id, user_id, ts, value, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3, "
    "avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) "
    "AS value_mean_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "event_id:i user_id:i ts:t value:d value_lag_1:d value_lag_3:d value_mean_3:d"))
def q_stream_lags(spark, sf_dir):
    """Per-user lag and rolling features on an event stream of three arrivals; some rows of an arrival's last hour come with
    the next one (late rows), and the stream is restarted after each arrival."""
    ev = FX.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    src, out, ck = X.scratch(spark, "x3-in"), X.scratch(spark, "x3-out"), X.scratch(spark, "x3-ck")
    soon = arrival(ev, 3, "ts")
    part = F.when((F.col("event_id") % 2 == 0) & (soon < arrival(ev, 3, F.col("ts") + F.expr("interval 1 hour"))), soon + 1).otherwise(soon)
    s = Series(keys=("user_id",), order=("ts", "event_id"))
    for k in range(3):
        X.arrive(ev, part, src, k)
        X.stream_lag_features(X.read_stream(spark, src, ev.schema), s, ["value"], [1, 3], [3], out, None, ck)
    return normalize(X.latest(spark.read.parquet(out), ["event_id"]))


def arrival(df, parts: int, ts="ts"):
    """In which of ``parts`` equal stretches of the table's time a row lies (from 0)."""
    ends = df.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b")).first()
    width = ((ends["b"] or 0.0) - (ends["a"] or 0.0)) / parts + 1.0
    t = (F.col(ts) if isinstance(ts, str) else ts).cast("double")
    return F.least(F.floor((t - F.lit(ends["a"] or 0.0)) / F.lit(width)).cast("int"), F.lit(parts - 1))
