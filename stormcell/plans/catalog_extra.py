"""Registered queries over sources and sinks, noise, infinities, capped weights and label helpers: each goes through what it
writes, or reaches the branch that the other queries do not."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import normalize
from ..operators import alerts as A
from ..operators import labels as LB
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import quality as Q
from ..operators import scale as N
from ..operators import splits as T
from ..operators import windows as WN
from ..operators.series import Series, with_positions
from ..sources import files as SRC
from ..sources import text as TX
from ..streaming.streams import scratch
from . import fixtures as FX
from . import oracle as O
from .catalog import PANEL_SPEC, QUERIES, SQL, cleaned, features, raw, register
from .catalog_eval import LEVELS_SQL, W
from .catalog_eval import sv
from .catalog_series import P, SEQ_COLS, SPLIT_SQL, _sentinel_sql, _seq_sql, _seq_summary, write_text

num = O.num
CHANNELS = TX.RAW_NAMES[3:]


# ------------------------------------------------------------------ sources and sinks
@register("s7_rejects", O.norm(
    P("v AS (SELECT seq, \"Year\", \"Day\", " + ", ".join(_sentinel_sql(c) for c in CHANNELS) + " FROM panel)",
      "m AS (SELECT count(*) AS lines, count(*) FILTER (WHERE seq = 1) AS rejects, sum(CASE WHEN seq = 0 THEN "
      + " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in CHANNELS) + " ELSE 0 END) AS missing FROM v)")
    + "SELECT \"Year\", \"Day\", count(*) AS rejected, lines, rejects, missing FROM v CROSS JOIN m WHERE seq = 1 "
      "GROUP BY \"Year\", \"Day\", lines, rejects, missing", "Year:i Day:i rejected:i lines:i rejects:i missing:i"))
def q_rejects(spark, sf_dir):
    """Rejected lines per day, with the counts observed while rows and rejects were written by one pass."""
    _rows, rejects, counts = TX.ingest_written(spark, write_text(spark, raw(spark, sf_dir)), scratch(spark, "ingested"))
    parts = F.split(F.trim("line"), r"\s+")
    per_day = rejects.groupBy(parts[0].cast("int").alias("Year"), parts[1].cast("int").alias("Day")).agg(F.count(F.lit(1)).alias("rejected"))
    return normalize(per_day.withColumns({k: F.lit(v).cast("long") for k, v in counts.items()}))


_CLEAN_COLS = [x.split(":")[0] for x in PANEL_SPEC.split()]


@register("s8_s9_s10_parquet_sink", O.norm(
    P(clean=True) + f"SELECT count(*) AS rows, {len(_CLEAN_COLS)} AS columns, min(ts) AS first_ts, max(ts) AS last_ts, sum("
    + " + ".join(f"(CASE WHEN \"{c}\" IS NULL THEN 1 ELSE 0 END)" for c in _CLEAN_COLS) + ") AS missing, 1 AS sized FROM cleaned",
    "rows:i columns:i first_ts:t last_ts:t missing:i sized:i"))
def q_parquet_sink(spark, sf_dir):
    """The cleaned series written as Parquet, profiled from what was written; file sizes from metadata."""
    path = scratch(spark, "cleaned")
    SRC.write_parquet(cleaned(spark, sf_dir).select(*_CLEAN_COLS), path)
    size = SRC.file_sizes(spark, path).first()
    sized = int(size["files"] > 0 and size["bytes"] > 0 and abs(size["megabytes"] * 1048576 - size["bytes"]) < 1)
    return normalize(SRC.profile(spark.read.parquet(path), "ts").withColumn("sized", F.lit(sized)))


@register("s15_s16_csv_scoring", O.norm(
    W() + f" SELECT l_orderkey, l_linenumber, blend, {LEVELS_SQL} AS alert_level FROM sv", "l_orderkey:i l_linenumber:i blend:d alert_level:s"))
def q_csv(spark, sf_dir):
    """S15 + S16 + A5: scores written as CSV with a header, read back under a schema and graded."""
    path = scratch(spark, "csv")
    SRC.write_csv(sv(spark, sf_dir).select("l_orderkey", "l_linenumber", "blend"), path)
    back = SRC.read_csv(spark, path, "l_orderkey long, l_linenumber int, blend double")
    A.require_columns(back, ["blend"])
    return normalize(A.predict_batch(back, "blend", ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", F.col("storm_probability").alias("blend"), "alert_level"))


@register("s16_json_metrics", SQL["e1_e2_e9_rates"])
def q_json(spark, sf_dir):
    """The metrics table written as JSON lines and read back under its schema."""
    rates, path = QUERIES["e1_e2_e9_rates"](spark, sf_dir), scratch(spark, "json")
    SRC.write_json(rates, path)
    return spark.read.schema(rates.schema).json(path).select(*rates.columns)


# ------------------------------------------------------------------ noise, infinities, weights, labels
def _noise_sql(x: str, i: int, seed: int, sigma: float) -> str:
    def u(stream):
        first = f"(((event_id % 2147483648) + {seed + stream}) * {T.SAMPLE_MULTIPLIER}) % 4294967296"
        return f"(((({first}) % 2147483648 + {seed + 7 * stream + 1}) * {T.SAMPLE_MULTIPLIER}) % 4294967296 + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    return f"{x} + sqrt(-2.0 * ln({u(2 * i)})) * cos(2.0 * pi() * {u(2 * i + 1)}) * {num(sigma)} AS {x}"


@register("t9_noise", O.norm(
    "WITH e AS (SELECT event_id, value, value * 2.0 AS twice FROM events) SELECT event_id, "
    + _noise_sql("value", 0, 11, 0.5) + ", " + _noise_sql("twice", 1, 11, 0.5) + " FROM e", "event_id:i value:d twice:d"))
def q_noise(spark, sf_dir):
    """Seeded Gaussian noise per row, whatever the partitions."""
    e = FX.table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") * 2.0).alias("twice"))
    return normalize(T.add_noise(e, ["value", "twice"], 0.5, 11, "event_id", "mult"))


def _ratio(spark, sf_dir):
    """A ratio with infinities of both signs, NaN and NULL, from lineitem."""
    x = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).when(F.col("l_quantity") == 1, F.lit(float("nan")))
    x = x.when(F.col("l_tax") == 0, F.lit(float("inf"))).when(F.col("l_discount") == 0, F.lit(float("-inf")))
    return FX.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.otherwise(F.try_divide("l_discount", "l_tax")).alias("ratio"))


def _ratio_sql(null: str, nan: str, high: str, low: str) -> str:
    return ("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN " + null + " WHEN l_quantity = 1 THEN " + nan
            + " WHEN l_tax = 0 THEN " + high + " WHEN l_discount = 0 THEN " + low + " ELSE l_discount / l_tax END AS ratio FROM lineitem")


@register("c14_inf_to_null", O.norm(_ratio_sql("NULL", "NULL", "NULL", "NULL"), "l_orderkey:i l_linenumber:i ratio:d"))
def q_inf(spark, sf_dir):
    """C14: infinities and NaN to NULL."""
    return normalize(Q.inf_to_null(_ratio(spark, sf_dir)))


@register("c19_infinities", O.norm(_ratio_sql("0.5", "0.5", "1.0", "0.0"), "l_orderkey:i l_linenumber:i ratio:d"))
def q_nan(spark, sf_dir):
    """Missing and NaN -> 0.5, +inf -> 1, -inf -> 0."""
    return normalize(Q.nan_to_num(_ratio(spark, sf_dir), ["ratio"], 0.5, 1.0, 0.0))


_RARE = "CASE WHEN l_quantity = 50 AND l_linenumber = 1 THEN 1 ELSE 0 END"


@register("n3_capped_weights", O.norm(
    f"SELECT {_RARE} AS class, count(*) AS count, least(CAST((SELECT count(*) FROM lineitem) AS DOUBLE) / (2 * count(*)), 10.0) AS weight "
    "FROM lineitem GROUP BY 1", "class:i count:i weight:d"))
def q_capped(spark, sf_dir):
    """N2 + N3: balanced weights of a rare class, whose cap of 10 binds."""
    li = FX.table(spark, sf_dir, "lineitem").select(F.expr(_RARE).alias("rare"))
    return normalize(N.class_weights(li, "rare", cap=10.0))


@register("e7_binarised", O.norm(
    W() + " SELECT split, CASE WHEN blend > 0.5 THEN 1 ELSE 0 END AS called, count(*) AS rows FROM sv GROUP BY 1, 2",
    "split:s called:i rows:i"))
def q_binarised(spark, sf_dir):
    """Scores made binary at 0.5 (strictly above), counted per split."""
    d = sv(spark, sf_dir).withColumn("called", M.binarise("blend"))
    return normalize(d.groupBy("split", "called").agg(F.count(F.lit(1)).alias("rows")))


@register("l3_l4_labels", O.norm(
    P("d AS (SELECT ts, Dst_index, Dst_index - lag(Dst_index) OVER (ORDER BY ts) AS Dst_Rate, CAST(lead(CASE WHEN Dst_index < -50 "
      "THEN 1 ELSE 0 END, 12) OVER (ORDER BY ts) AS DOUBLE) AS Storm_12h_Ahead FROM cleaned)", clean=True)
    + "SELECT ts, Dst_Rate, CASE WHEN Dst_Rate < -30 THEN 1 ELSE 0 END AS Storm_Onset, Storm_12h_Ahead FROM d",
    "ts:t Dst_Rate:d Storm_Onset:i Storm_12h_Ahead:d"))
def q_labels(spark, sf_dir):
    """L3 + L4 as operators of their own: onset, and the look-ahead label with another horizon."""
    s = Series(order=("ts",))
    d = LB.ahead_label(LB.onset_label(cleaned(spark, sf_dir), s), s, 12, name="Storm_12h_Ahead")
    return normalize(d.select("ts", "Dst_Rate", "Storm_Onset", "Storm_12h_Ahead"))


_L6 = [c for c in _CLEAN_COLS if c not in ("ts", "seq", "Kp_index")]


@register("l6_split_features", O.norm(
    P(clean=True) + f"SELECT ts, {SPLIT_SQL} AS split, " + ", ".join(f'"{c}"' for c in _L6)
    + ", CASE WHEN Kp_index / 10.0 >= 5 THEN 1 ELSE 0 END AS Storm FROM cleaned",
    "ts:t split:s " + " ".join(f"{c}:{'i' if c in TX.TIME_PARTS else 'd'}" for c in _L6) + " Storm:i"))
def q_split_features(spark, sf_dir):
    """Features and label apart from what the label is made of; L7 names what would leak."""
    c = LB.kp_labels(cleaned(spark, sf_dir).drop("seq")).withColumn("split", FX.panel_split())
    d, feats = LB.split_features(c)
    LB.assert_no_leakage(feats, allow=["Dst_index"])
    return normalize(d)


@register("c10_sorted", O.norm(
    "SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS position FROM events", "event_id:i position:i"))
def q_sorted(spark, sf_dir):
    """Total sort by keys and order; a row's place is read off the sorted partitions."""
    ev = FX.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    done = Q.sort_series(ev, Series(keys=("user_id",), order=("ts", "event_id"))).select("event_id", F.monotonically_increasing_id().alias("_at"))
    return normalize(with_positions(done, Series(order=("_at",)), "position").select("event_id", "position"))


@register("w8_fallback_sequences", _seq_sql(24, 1, False).replace("Storm_Binary, IMF_Bz, ", "Storm_Binary, CAST(NULL AS DOUBLE) AS IMF_Bz, ", 1))
def q_fallback(spark, sf_dir):
    """No window is complete (one input is missing throughout), so all windows come unchecked."""
    f = features(spark, sf_dir).withColumn("IMF_Bz", F.lit(None).cast("double"))
    return normalize(_seq_summary(WN.sequences_with_fallback(f, Series(order=("ts",)), SEQ_COLS, "Storm_Binary", 24, 3)))


@register("m10_m14_bundle", O.norm(
    W() + " SELECT split, count(*) AS rows, 0 AS differing, 'b.json' AS latest_meta FROM sv GROUP BY split",
    "split:s rows:i differing:i latest_meta:s"))
def q_bundle(spark, sf_dir):
    """M10 + M12 + M14 + A2: a fitted model saved with its metadata, loaded and found by name again, scores as before."""
    d, feats, path = sv(spark, sf_dir), ["p1", "p2", "p3"], scratch(spark, "bundle")
    model = MD.fit_logistic(d.where(F.col("split") == "train"), feats, "y2")
    MD.save_bundle(path, {"logistic": model}, {"features": feats})
    models, meta = MD.load_bundle(path, ["logistic"])
    for name in ("a.json", "b.json"):
        SRC.write_json(spark.createDataFrame([(name,)], "name string").coalesce(1), f"{path}/runs/{name}")
    both = MD.score(MD.score(d, model, "before"), models["logistic"], "after")
    newest = MD.latest_folder(spark, f"{path}/runs") if meta["features"] == feats else None
    return normalize(both.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("before") != F.col("after"), 1)).alias("differing"),
        F.lit(newest).alias("latest_meta")))
