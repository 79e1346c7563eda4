"""Registered queries over the hourly series, events and orders: quality reports, labels,
splits, sampling, sequences and metric-history checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import normalize
from ..operators import features as FE
from ..operators import labels as LB
from ..operators import quality as Q
from ..operators import splits as T
from ..operators import windows as WN
from ..operators.series import Series, hourly_spine, window_apply, with_positions
from ..sources import files as SRC
from . import fixtures as FX
from . import oracle as O
from .catalog import DEMO_BLOCK_ROWS, PANEL_SPEC, cleaned, features, raw, register

num = O.num
CH = list(Q.RANGE_LIMITS)


def P(*ctes: str, keyed: bool = False, clean: bool = False, feats: bool = False) -> str:
    parts = [O.panel_ctes(keyed)]
    if clean or feats:
        parts.append(O.clean_ctes(keyed))
    if feats:
        parts.append(O.feature_ctes(keyed))
    return O.with_ctes(*parts, *ctes) + "\n"


def ev_series() -> Series:
    return Series(keys=("user_id",), order=("ts", "event_id"), block_rows=DEMO_BLOCK_ROWS)


# ------------------------------------------------------------------ quality
@register("c1_flags", O.norm(
    P() + "SELECT ts, seq, " + ", ".join(
        f"CASE WHEN {c} < {num(lo)} OR {c} > {num(hi)} THEN 1 ELSE 0 END AS {c}_anomaly"
        for c, (lo, hi) in Q.RANGE_LIMITS.items()) + " FROM panel",
    "ts:t seq:i " + " ".join(f"{c}_anomaly:i" for c in CH)))
def q_flags(spark, sf_dir):
    """Range flags per row (missing is not flagged)."""
    d = Q.flag_ranges(raw(spark, sf_dir))
    return normalize(d.select("ts", "seq", *[f"{c}_anomaly" for c in CH]))


@register("c2_range_report", O.norm(
    P("fl AS (SELECT " + ", ".join(f"sum(CASE WHEN {c} < {num(lo)} OR {c} > {num(hi)} THEN 1 ELSE 0 END) AS {c}"
                                   for c, (lo, hi) in Q.RANGE_LIMITS.items()) + ", count(*) AS n FROM panel)",
      "lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, {c} AS anomalies, n FROM fl" for c in CH)
      + " UNION ALL SELECT 'TOTAL', " + " + ".join(CH) + ", n FROM fl)")
    + "SELECT channel, anomalies, CAST(anomalies AS DOUBLE) / n * 100 AS percent, n AS rows FROM lg",
    "channel:s anomalies:i percent:d rows:i"))
def q_range_report(spark, sf_dir):
    """Flagged count and percent per channel plus TOTAL."""
    return normalize(Q.range_report(raw(spark, sf_dir)))


@register("c3_multi_flag", O.norm(
    P(f"fl AS (SELECT ts, seq, {O.flags_expr()} AS nflags FROM panel)")
    + f"SELECT ts, seq, nflags FROM fl WHERE nflags < {Q.MULTI_FLAG_LIMIT}", "ts:t seq:i nflags:i"))
def q_multi_flag(spark, sf_dir):
    """Rows kept after dropping those with three or more flags (flag count shown)."""
    d = Q.flag_ranges(raw(spark, sf_dir))
    d = d.withColumn("nflags", Q.flag_count(d))
    return normalize(Q.drop_multi_flag(d).select("ts", "seq", "nflags"))


FILL_CH = [*Q.INTERPOLATED, *Q.INDEX_CHANNELS]


@register("c7_fill_report", O.norm(
    P("b AS (SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in FILL_CH) + " FROM panel)",
      "a AS (SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in FILL_CH) + " FROM cleaned)",
      "lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, b.{c} AS mb, a.{c} AS ma FROM a, b" for c in FILL_CH)
      + " UNION ALL SELECT 'TOTAL', " + " + ".join(f"b.{c}" for c in FILL_CH) + ", "
      + " + ".join(f"a.{c}" for c in FILL_CH) + " FROM a, b)", clean=True)
    + "SELECT channel, mb AS missing_before, ma AS missing_after, "
      "CASE WHEN mb = 0 THEN NULL ELSE CAST(mb - ma AS DOUBLE) / mb * 100 END AS percent_filled FROM lg",
    "channel:s missing_before:i missing_after:i percent_filled:d"))
def q_fill_report(spark, sf_dir):
    """Missing values before and after cleaning per channel."""
    return normalize(Q.fill_report(raw(spark, sf_dir), cleaned(spark, sf_dir), FILL_CH))


LI_KEYS = ["l_orderkey", "l_linenumber"]
LI_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
            "l_linestatus", "l_shipdate"]


@register("c8_dup_count", O.norm(
    "SELECT coalesce(sum(n - 1), 0) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicate_keys FROM "
    "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)", "duplicate_rows:i duplicate_keys:i"))
def q_dup_count(spark, sf_dir):
    """C8 on (l_orderkey, l_linenumber)."""
    return normalize(Q.dup_count(FX.table(spark, sf_dir, "lineitem"), LI_KEYS))


@register("c9_dedupe", O.norm(
    "SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY "
    + ", ".join(LI_ORDER) + ") AS rk FROM lineitem) WHERE rk = 1",
    "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d "
    "l_returnflag:s l_linestatus:s l_shipdate:t"))
def q_dedupe(spark, sf_dir):
    """First row per key by an explicit total order."""
    return normalize(Q.dedupe(FX.table(spark, sf_dir, "lineitem"), LI_KEYS, LI_ORDER))


@register("c11_gap_report", O.norm(
    "SELECT user_id, count(step) AS steps, count(*) FILTER (WHERE step > 21600000000) AS gaps_over_limit, "
    "max(step) / 3600000000.0 AS max_gap_hours FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER "
    "(PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events) GROUP BY user_id",
    "user_id:i steps:i gaps_over_limit:i max_gap_hours:d"))
def q_gap_report(spark, sf_dir):
    """C11 per user: steps, steps over 6 hours, longest step."""
    return normalize(Q.gap_report(FX.table(spark, sf_dir, "events"), ev_series(), "ts", "6 hours"))


def _nulls(cols):
    return " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in cols)


PANEL_COLS = ["ts", "seq", "Year", "Day", "Hour", *O.RAW_COLS]


@register("c12_quality_report", O.norm(
    P(clean=True) + f"SELECT b.rows_before, a.rows_after, b.missing_before, a.missing_after, a.first_ts, a.last_ts, "
    "CAST(a.rows_after AS DOUBLE) / b.rows_before * 100 AS percent_kept FROM "
    f"(SELECT count(*) AS rows_before, sum({_nulls(PANEL_COLS)}) AS missing_before FROM panel) b, "
    f"(SELECT count(*) AS rows_after, sum({_nulls(PANEL_COLS)}) AS missing_after, min(ts) AS first_ts, "
    "max(ts) AS last_ts FROM cleaned) a",
    "rows_before:i rows_after:i missing_before:i missing_after:i first_ts:t last_ts:t percent_kept:d"))
def q_quality_report(spark, sf_dir):
    """Rows and missing cells before/after cleaning, time range."""
    return normalize(Q.quality_report(raw(spark, sf_dir), cleaned(spark, sf_dir)))


@register("c13_completeness", O.norm(
    P(clean=True) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
        f"(1 - CAST(count(*) - count({c}) AS DOUBLE) / count(*)) * 100 AS completeness FROM cleaned"
        for c in PANEL_COLS), "column:s missing:i completeness:d"))
def q_completeness(spark, sf_dir):
    """C13 on the cleaned series."""
    return normalize(Q.completeness(cleaned(spark, sf_dir)))


FEATURE_COLS = [c for c in FE.feature_order() if c != "ts"]


@register("c15_high_missing", O.norm(
    P(feats=True) + "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, "
        f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100 AS percent FROM features" for c in FEATURE_COLS)
    + ") WHERE missing > rows * 0.1", "column:s rows:i missing:i percent:d"))
def q_high_missing(spark, sf_dir):
    """Feature columns with more than 10 % missing."""
    return normalize(Q.high_missing(features(spark, sf_dir), 0.1, FEATURE_COLS))


FILL_COLS = ["IMF_Bz_lag_24h", "Flow_Speed_lag_24h", "Dst_Rate", "IMF_Bz_std_3h", "Storm_6h_Ahead"]
SPLIT_SQL = "CASE WHEN day(ts) <= 20 THEN 'train' WHEN day(ts) <= 25 THEN 'validation' ELSE 'test' END"


@register("c16_fill_all", O.norm(
    P(f"sp AS (SELECT ts, {SPLIT_SQL} AS split, {', '.join(FILL_COLS)} FROM features)", feats=True)
    + "SELECT ts, split, " + ", ".join(
        f"coalesce({c}, last_value({c} IGNORE NULLS) OVER (PARTITION BY split ORDER BY ts ROWS BETWEEN UNBOUNDED "
        f"PRECEDING AND 1 PRECEDING), first_value({c} IGNORE NULLS) OVER (PARTITION BY split ORDER BY ts ROWS "
        f"BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0) AS {c}" for c in FILL_COLS) + " FROM sp",
    "ts:t split:s " + " ".join(f"{c}:d" for c in FILL_COLS)))
def q_fill_all(spark, sf_dir):
    """Forward, backward, zero fill per split."""
    f = features(spark, sf_dir).select("ts", FX.panel_split().alias("split"), *FILL_COLS)
    s = Series(keys=("split",), order=("ts",), block_rows=DEMO_BLOCK_ROWS)
    return normalize(Q.fill_all(f, s, FILL_COLS))


@register("c16_fill_forward", O.norm(
    P(f"sp AS (SELECT ts, {SPLIT_SQL} AS split, {', '.join(FILL_COLS)} FROM features)", feats=True)
    + "SELECT ts, split, " + ", ".join(
        f"coalesce({c}, last_value({c} IGNORE NULLS) OVER (PARTITION BY split ORDER BY ts ROWS BETWEEN UNBOUNDED "
        f"PRECEDING AND 1 PRECEDING), 0.0) AS {c}" for c in FILL_COLS) + " FROM sp",
    "ts:t split:s " + " ".join(f"{c}:d" for c in FILL_COLS)))
def q_fill_forward(spark, sf_dir):
    """C16 without the backward fill, which looks ahead in time."""
    f = features(spark, sf_dir).select("ts", FX.panel_split().alias("split"), *FILL_COLS)
    s = Series(keys=("split",), order=("ts",), block_rows=DEMO_BLOCK_ROWS)
    return normalize(Q.fill_all(f, s, FILL_COLS, backward=False))


@register("w1_hourly_spine_users", O.norm(
    "WITH c AS (SELECT user_id, date_trunc('hour', ts) AS ts, count(*) AS events, max(value) AS top FROM events "
    "GROUP BY ALL), e AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM c GROUP BY user_id), "
    "h AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM e), "
    "j AS (SELECT h.user_id, h.ts, coalesce(c.events, 0) AS events, c.top FROM h LEFT JOIN c ON h.user_id = c.user_id AND h.ts = c.ts) "
    "SELECT *, lag(top, 3) OVER (PARTITION BY user_id ORDER BY ts) AS top_lag_3h FROM j",
    "user_id:i ts:t events:i top:d top_lag_3h:d"))
def q_spine(spark, sf_dir):
    """W1 over hours, not rows: missing hours of every user are put in before the lag."""
    cells = (FX.table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("ts"))
             .agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("top")))
    s = Series(keys=("user_id",), order=("ts",), block_rows=DEMO_BLOCK_ROWS)
    hours = hourly_spine(cells, ["user_id"]).fillna(0, ["events"])
    return normalize(window_apply(hours, s, lambda w: {"top_lag_3h": F.lag("top", 3).over(w)}, before=3))


@register("c17_feature_consistency", O.norm(
    P(feats=True) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, "
        f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100 AS percent, "
        f"'{'int' if c in ('Storm_Binary', 'Storm_Intensity', 'Storm_Onset') else 'double'}' AS dtype FROM features"
        for c in FEATURE_COLS), "column:s rows:i missing:i percent:d dtype:s"))
def q_consistency(spark, sf_dir):
    """C17: missing count, percent and type per feature."""
    return normalize(Q.feature_consistency(features(spark, sf_dir), FEATURE_COLS))


LI_NUM = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
          "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double"}


def _narrow_sql() -> str:
    parts = []
    for c, t in LI_NUM.items():
        if t in ("bigint", "int"):
            nt = (f"CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' "
                  f"WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' "
                  f"WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE '{t}' END")
        else:
            nt = (f"CASE WHEN min({c}) > -3.4028234663852886e38 AND max({c}) < 3.4028234663852886e38 "
                  f"THEN 'float' ELSE '{t}' END")
        parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, {nt} AS narrow_dtype, "
                     f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem")
    return O.norm(" UNION ALL ".join(parts), "column:s dtype:s narrow_dtype:s min:d max:d")


@register("c18_narrow_plan", _narrow_sql())
def q_narrow(spark, sf_dir):
    """Narrowest type per numeric column from one min/max aggregate."""
    return normalize(Q.narrow_plan(FX.table(spark, sf_dir, "lineitem"), list(LI_NUM)))


NAN_COLS = ["Dst_Rate", "IMF_Bz_std_3h", "Storm_6h_Ahead", "IMF_Cone_Angle"]


@register("c19_nan_to_num", O.norm(
    P(feats=True) + "SELECT ts, " + ", ".join(f"coalesce({c}, 0.5) AS {c}" for c in NAN_COLS) + " FROM features",
    "ts:t " + " ".join(f"{c}:d" for c in NAN_COLS)))
def q_nan_to_num(spark, sf_dir):
    """Missing -> 0.5 (+inf -> 1, -inf -> 0)."""
    return normalize(Q.nan_to_num(features(spark, sf_dir).select("ts", *NAN_COLS), NAN_COLS, 0.5, 1.0, 0.0))


# ------------------------------------------------------------------ labels and splits
@register("l5_corrected", O.norm(
    P(clean=True) + "SELECT *, Kp_index / 10.0 AS Kp_actual, CASE WHEN Kp_index / 10.0 >= 5 THEN 1 ELSE 0 END AS Storm, "
    "CASE WHEN Kp_index / 10.0 >= 4 THEN 1 ELSE 0 END AS Moderate_Storm FROM cleaned",
    PANEL_SPEC + " Kp_actual:d Storm:i Moderate_Storm:i"))
def q_corrected(spark, sf_dir):
    """Corrected table = cleaned series + Kp_actual, Storm, Moderate_Storm."""
    return normalize(LB.kp_labels(cleaned(spark, sf_dir)))


ORD_SPLIT = ("CASE WHEN year(o_orderdate) <= 1997 THEN 'train' WHEN year(o_orderdate) <= 1999 THEN 'validation' "
             "ELSE 'test' END")


def orders_split(spark, sf_dir):
    o = FX.table(spark, sf_dir, "orders")
    return T.time_split(o, "o_orderdate", 1997, 1999)


@register("t1_t3_split_summary", O.norm(
    f"SELECT {ORD_SPLIT} AS split, count(*) AS rows, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts, "
    "avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS label_rate FROM orders GROUP BY 1",
    "split:s rows:i first_ts:t last_ts:t label_rate:d"))
def q_split_summary(spark, sf_dir):
    """T1 + T3 on orders by year."""
    o = orders_split(spark, sf_dir).withColumn("done", (F.col("o_orderstatus") == "F").cast("int"))
    return normalize(T.split_summary(o, "done", "o_orderdate"))


@register("t2_date_split", O.norm(
    "SELECT CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '2000-01-01' "
    "THEN 'validation' ELSE 'test' END AS split, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem "
    "GROUP BY 1", "split:s rows:i quantity:d"))
def q_date_split(spark, sf_dir):
    """Split by date limits."""
    d = T.date_split(FX.table(spark, sf_dir, "lineitem"), "l_shipdate", "1999-01-01", "2000-01-01")
    return normalize(d.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity")))


@register("t4_split_overlap", O.norm(
    f"WITH b AS (SELECT {ORD_SPLIT} AS split, min(o_orderdate) AS mn, max(o_orderdate) AS mx FROM orders GROUP BY 1), "
    "r AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS k FROM b) "
    "SELECT e.split AS earlier, l.split AS later, CASE WHEN e.mx >= l.mn THEN 1 ELSE 0 END AS overlap, "
    "CAST(date_diff('second', e.mx, l.mn) AS DOUBLE) / 3600 AS gap_hours FROM r e JOIN r l ON l.k = e.k + 1",
    "earlier:s later:s overlap:i gap_hours:d"))
def q_overlap(spark, sf_dir):
    """T4: overlap or gap between consecutive splits."""
    return normalize(T.split_overlap(orders_split(spark, sf_dir), "o_orderdate"))


@register("t5_value_distribution", O.norm(
    f"SELECT split, o_orderpriority, c AS count, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY split) * 100 AS percent "
    f"FROM (SELECT {ORD_SPLIT} AS split, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2)",
    "split:s o_orderpriority:s count:i percent:d"))
def q_value_dist(spark, sf_dir):
    """T5: share of each priority per split."""
    return normalize(T.value_distribution(orders_split(spark, sf_dir), "o_orderpriority"))


@register("t6_event_rates", O.norm(
    P(f"sp AS (SELECT {SPLIT_SQL} AS split, Kp_index FROM cleaned)", clean=True)
    + "SELECT split, count(*) AS rows, l.lim AS limit, count(*) FILTER (WHERE Kp_index / 10.0 >= l.lim) AS events, "
      "CAST(count(*) FILTER (WHERE Kp_index / 10.0 >= l.lim) AS DOUBLE) / count(*) AS rate FROM sp, "
      "(VALUES (4.0), (5.0)) AS l(lim) GROUP BY split, l.lim",
    "split:s rows:i limit:d events:i rate:d"))
def q_event_rates(spark, sf_dir):
    """Kp >= 4 and >= 5 rates per split (Kp stored x10: scale 10)."""
    c = cleaned(spark, sf_dir).withColumn("split", FX.panel_split())
    return normalize(T.event_rates(c, "Kp_index", [4.0, 5.0], ["split"], 10.0))


MULT = T.SAMPLE_MULTIPLIER


@register("t7_sample_exact", O.norm(
    "SELECT event_id, ts, user_id, value FROM (SELECT *, row_number() OVER (ORDER BY "
    f"((event_id + 42) * {MULT}) % 4294967296, event_id) AS rk, count(*) OVER () AS n FROM events) "
    "WHERE rk <= floor(0.1 * n)", "event_id:i ts:t user_id:i value:d"))
def q_sample(spark, sf_dir):
    """Exactly floor(0.1 N) events by a seeded hash order."""
    d = T.sample_exact(FX.table(spark, sf_dir, "events"), 0.1, 42, "event_id", method="mult")
    return normalize(d.select("event_id", "ts", "user_id", "value"))


@register("t8_shuffle", O.norm(
    f"SELECT event_id, ((event_id + 7) * {MULT}) % 4294967296 AS shuffle_key, row_number() OVER (ORDER BY "
    f"((event_id + 7) * {MULT}) % 4294967296, event_id) - 1 AS position FROM events", "event_id:i shuffle_key:i position:i"))
def q_shuffle(spark, sf_dir):
    """Seeded shuffle order key, and the place that it gives to each row."""
    d = T.shuffle(FX.table(spark, sf_dir, "events").select("event_id"), 7, "event_id", method="mult")
    d = with_positions(d, Series(order=("shuffle_key", "event_id")), "position")
    return normalize(d.select("event_id", "shuffle_key", "position"))


@register("t10_consecutive_breach", O.norm(
    "WITH e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, "
    "value > 60 AS hit FROM events), "
    "g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, hit ORDER BY pos) AS isl FROM e WHERE pos >= 5), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY pos) AS k FROM g WHERE hit) "
    "SELECT user_id, min(pos) AS stop_position, arg_min(ts, pos) AS stop_ts FROM r WHERE k >= 3 GROUP BY user_id",
    "user_id:i stop_position:i stop_ts:t"))
def q_breach(spark, sf_dir):
    """First event (from position 5) ending three consecutive values > 60, per user."""
    e = FX.table(spark, sf_dir, "events")
    return normalize(T.consecutive_breach(e, ev_series(), F.col("value") > 60, 3, 5))


@register("t11_best_row", O.norm(
    "SELECT user_id, event_id, ts, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY value, ts, event_id) AS rk FROM events) WHERE rk = 1",
    "user_id:i event_id:i ts:t event_type:s value:d props:s"))
def q_best_row(spark, sf_dir):
    """Least value per user (ties by time, id)."""
    return normalize(T.best_row(FX.table(spark, sf_dir, "events"), ["user_id"], "value", ["ts", "event_id"]))


# ------------------------------------------------------------------ windows over the feature table
def _seq_summary(d):
    flat = F.flatten("sequence")
    return d.select("ts", "position", "label", F.size("sequence").alias("steps"), F.size(flat).alias("cells"),
                    F.aggregate(flat, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("total"),
                    F.element_at(F.element_at("sequence", 1), 1).alias("first_cell"),
                    F.element_at(F.element_at("sequence", -1), -1).alias("last_cell"))


SEQ_COLS = ["IMF_Bz", "Flow_Speed", "Dst_index"]


def _seq_sql(length: int, stride: int, check: bool, split: str | None = None) -> str:
    part = "PARTITION BY side " if split else ""
    side = f", CASE WHEN ts >= TIMESTAMP '{split}' THEN 'after' ELSE 'before' END AS side" if split else ""
    fr = f"OVER ({part}ORDER BY ts ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)"
    bad = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in SEQ_COLS)
    cells = " + ".join(f"coalesce({c}, 0.0)" for c in SEQ_COLS)
    cond = f"pos >= {length} AND (pos - {length}) % {stride} = 0" + (" AND nbad = 0" if check else "")
    return O.norm(
        P(f"b AS (SELECT ts, Storm_Binary, {', '.join(SEQ_COLS)}{side} FROM features)", feats=True)
        + f"SELECT ts, pos AS position, Storm_Binary AS label, cnt AS steps, cnt * {len(SEQ_COLS)} AS cells, total, "
          f"first_cell, last_cell FROM (SELECT ts, Storm_Binary, row_number() OVER ({part}ORDER BY ts) - 1 AS pos, "
          f"count(*) {fr} AS cnt, sum(CASE WHEN {bad} > 0 THEN 1 ELSE 0 END) {fr} AS nbad, "
          f"sum({cells}) {fr} AS total, first_value({SEQ_COLS[0]}) {fr} AS first_cell, "
          f"last_value({SEQ_COLS[-1]}) {fr} AS last_cell FROM b) WHERE {cond}",
        "ts:t position:i label:i steps:i cells:i total:d first_cell:d last_cell:d")


@register("w7_sequences", _seq_sql(24, 6, True))
def q_sequences(spark, sf_dir):
    """24-row windows before every 6th row, complete windows only (summarised)."""
    s = Series(order=("ts",), block_rows=DEMO_BLOCK_ROWS)
    d = WN.sequences(features(spark, sf_dir), s, SEQ_COLS, "Storm_Binary", 24, 6, True)
    return normalize(_seq_summary(d))


@register("w9_safe_sequences", _seq_sql(12, 1, False, "2024-01-21 00:00:00"))
def q_safe_sequences(spark, sf_dir):
    """12-row windows that do not straddle the split time (summarised)."""
    s = Series(order=("ts",), block_rows=DEMO_BLOCK_ROWS)
    d = WN.safe_sequences(features(spark, sf_dir), s, SEQ_COLS, "Storm_Binary", "2024-01-21 00:00:00", 12)
    return normalize(_seq_summary(d))


@register("w6_rolling_median", O.norm(
    P("r AS (SELECT ts, avg(IMF_Bz) OVER w AS IMF_Bz_roll, avg(Flow_Speed) OVER w AS Flow_Speed_roll FROM cleaned "
      "WINDOW w AS (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))", clean=True)
    + "SELECT ts, coalesce(IMF_Bz_roll, (SELECT quantile_cont(IMF_Bz_roll, 0.5) FROM r), 0.0) AS IMF_Bz_roll, "
      "coalesce(Flow_Speed_roll, (SELECT quantile_cont(Flow_Speed_roll, 0.5) FROM r), 0.0) AS Flow_Speed_roll FROM r",
    "ts:t IMF_Bz_roll:d Flow_Speed_roll:d"))
def q_rolling_median(spark, sf_dir):
    """24-row rolling mean, remaining gaps -> median of the rolling mean."""
    s = Series(order=("ts",), block_rows=DEMO_BLOCK_ROWS)
    d = WN.rolling_fill_median(cleaned(spark, sf_dir).select("ts", "IMF_Bz", "Flow_Speed"), s,
                               ["IMF_Bz", "Flow_Speed"], 24)
    return normalize(d.select("ts", "IMF_Bz_roll", "Flow_Speed_roll"))


@register("w10_sequence_backfill", O.norm(
    P(f"b AS (SELECT ts, {SPLIT_SQL} AS split, Newell_Coupling_mean_24h AS sc, row_number() OVER "
      f"(PARTITION BY {SPLIT_SQL} ORDER BY ts) - 1 AS pos FROM features)", feats=True)
    + "SELECT ts, split, CASE WHEN pos < 72 THEN coalesce(i.init, 0.5) ELSE coalesce(sc, 0.5) END AS sequence_score "
      "FROM b LEFT JOIN (SELECT split, avg(coalesce(sc, 0.5)) AS init FROM b WHERE pos >= 72 AND pos < 82 GROUP BY split) i "
      "USING (split)", "ts:t split:s sequence_score:d"))
def q_backfill(spark, sf_dir):
    """Per split, first 72 rows get the mean of the next 10 scores."""
    f = features(spark, sf_dir).select("ts", FX.panel_split().alias("split"), "Newell_Coupling_mean_24h")
    s = Series(keys=("split",), order=("ts",), block_rows=DEMO_BLOCK_ROWS)
    d = WN.sequence_backfill(f, s, "Newell_Coupling_mean_24h", 72, 10, 0.5)
    return normalize(d.select("ts", "split", "sequence_score"))


# ------------------------------------------------------------------ sources over the driver tables
from ..streaming.streams import scratch  # noqa: E402


@register("s8_profile", O.norm(
    P() + f"SELECT count(*) AS rows, {len(PANEL_COLS)} AS columns, min(ts) AS first_ts, max(ts) AS last_ts, "
          f"sum({_nulls(PANEL_COLS)}) AS missing FROM panel", "rows:i columns:i first_ts:t last_ts:t missing:i"))
def q_profile(spark, sf_dir):
    """Shape, time range and total missing of the raw series."""
    return normalize(SRC.profile(raw(spark, sf_dir), "ts"))


@register("s12_s14_union", O.norm(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, year(l_shipdate) AS ship_year FROM lineitem",
    "l_orderkey:i l_linenumber:i l_quantity:d l_shipdate:t ship_year:i"))
def q_union(spark, sf_dir):
    """S11-S14 + S9: lineitem written as one folder per year, the folders read as one tagged bag by one scan, fixed column
    subset, dropped columns."""
    li = FX.table(spark, sf_dir, "lineitem").withColumn("part", F.year("l_shipdate"))
    path = scratch(spark, "years")
    SRC.write_parquet(li, path, partition_by=["part"])
    years = [r["y"] for r in li.groupBy(F.col("part").alias("y")).count().select("y").collect()]  # one row per year (and NULL)
    parts = [f"{path}/part={'__HIVE_DEFAULT_PARTITION__' if y is None else y}" for y in years]
    if not parts:
        return normalize(li.selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "part AS ship_year"))
    u = SRC.read_tagged(spark, parts, "ship_year", years)
    u = SRC.drop_if_present(u, ["l_comment", "l_tax", "l_discount"])
    return normalize(SRC.select_columns(u, ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "ship_year"]))


# ------------------------------------------------------------------ text ingest over Spark-written text
from ..sources import text as TX  # noqa: E402

MISSING_CODE = "99999.9"


def _sentinel_sql(c: str) -> str:
    codes = ", ".join(num(v) for v in TX.SENTINELS)
    return f"CASE WHEN {c} IN ({codes}) THEN NULL ELSE {c} END AS {c}"


@register("s1_s7_text_ingest", O.norm(
    P() + "SELECT ts, \"Year\", \"Day\", \"Hour\", " + ", ".join(_sentinel_sql(c) for c in TX.RAW_NAMES[3:])
    + " FROM panel WHERE seq = 0",
    "ts:t Year:i Day:i Hour:i " + " ".join(f"{c}:d" for c in TX.RAW_NAMES[3:])))
def q_text_ingest(spark, sf_dir):
    """The raw series written by Spark as whitespace text (missing -> sentinel code,
    repeated hours with a corrupt field), read back: parse, reject, sentinels, time parts, timestamp."""
    rows, _rejects = TX.ingest(spark, write_text(spark, raw(spark, sf_dir)))
    return normalize(rows.select("ts", *TX.RAW_NAMES))


def write_text(spark, r) -> str:
    """The raw series as whitespace text below a fresh folder; repeated hours have a field that does not parse."""
    hour = F.when(F.col("seq") == 1, F.lit("n/a")).otherwise(F.col("Hour").cast("string"))
    fields = [F.col("Year").cast("string"), F.col("Day").cast("string"), hour]
    fields += [F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CODE)) for c in TX.RAW_NAMES[3:]]
    path = scratch(spark, "text")
    r.select(F.concat_ws("   ", *fields).alias("value")).write.text(path)
    return path
