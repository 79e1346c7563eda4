"""Data quality and cleaning."""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.columns import finite_or_null_sql, floating_columns, numeric_columns, safe_div
from .series import POS, Series, ensure_positions, window_apply, with_neighbours

# Physical limits per channel (inclusive ranges), fill rules and cleaning limits
RANGE_LIMITS = {
    "IMF_Magnitude": (0.0, 100.0),
    "IMF_Bz": (-100.0, 100.0),
    "IMF_By": (-100.0, 100.0),
    "IMF_Bx": (-100.0, 100.0),
    "Flow_Speed": (200.0, 1200.0),
    "Proton_Density": (0.1, 200.0),
    "Proton_Temp": (1000.0, 2000000.0),
    "Flow_Pressure": (0.0, 50.0),
    "Dst_index": (-600.0, 100.0),
    "AE_index": (0.0, 4000.0),
    "Kp_index": (0.0, 90.0),
}
INTERPOLATED = ["IMF_Magnitude", "IMF_Bz", "IMF_By", "IMF_Bx", "Flow_Speed", "Proton_Density", "Proton_Temp"]
INDEX_CHANNELS = ["Dst_index", "AE_index", "Kp_index"]
INTERP_LIMIT = 6
FFILL_AFTER_INTERP = 2
INDEX_FFILL = 1
MULTI_FLAG_LIMIT = 3
GAP_LIMIT = "6 hours"
HIGH_MISSING_FRACTION = 0.1
FLAG_SUFFIX = "_anomaly"


def _present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


# ---------------------------------------------------------------- C1-C3 range flags
def flag_ranges(df: DataFrame, limits: Mapping[str, tuple] = RANGE_LIMITS, suffix: str = FLAG_SUFFIX) -> DataFrame:
    """Boolean flag per channel, value outside [lo, hi]; a missing value is not flagged."""
    return df.withColumns({
        f"{c}{suffix}": F.coalesce((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi)), F.lit(False))
        for c, (lo, hi) in limits.items() if c in df.columns})


def range_report(df: DataFrame, limits: Mapping[str, tuple] = RANGE_LIMITS, keys: Sequence[str] = ()) -> DataFrame:
    """Per channel the number and percent of flagged rows, plus a TOTAL row; one pass."""
    chans = _present(df, limits)
    flagged = flag_ranges(df.select(*keys, *chans), {c: limits[c] for c in chans})
    aggs = [F.sum(F.col(f"{c}{FLAG_SUFFIX}").cast("long")).alias(c) for c in chans]
    wide = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    wide = wide.withColumn("TOTAL", sum((F.col(c) for c in chans), F.lit(0).cast("long")))
    long = wide.unpivot([*keys, "_rows"], [*chans, "TOTAL"], "channel", "anomalies")
    return long.select(*keys, "channel", "anomalies",
                       (safe_div("anomalies", "_rows") * 100.0).alias("percent"),
                       F.col("_rows").alias("rows"))


def flag_count(df: DataFrame, limits: Mapping[str, tuple] = RANGE_LIMITS, suffix: str = FLAG_SUFFIX):
    return sum((F.col(f"{c}{suffix}").cast("int") for c in limits if f"{c}{suffix}" in df.columns), F.lit(0))


def drop_multi_flag(df: DataFrame, k: int = MULTI_FLAG_LIMIT, limits: Mapping[str, tuple] = RANGE_LIMITS,
                    keep_flags: bool = False) -> DataFrame:
    """Drop rows with at least ``k`` flags.  Flags already present are used (computed
    on raw values before filling); otherwise they are computed here."""
    have = any(f"{c}{FLAG_SUFFIX}" in df.columns for c in limits)
    d = df if have else flag_ranges(df, limits)
    d = d.where(flag_count(d, limits) < k)
    return d if keep_flags else d.drop(*[f"{c}{FLAG_SUFFIX}" for c in limits])


def null_out_of_range(df: DataFrame, limits: Mapping[str, tuple] = RANGE_LIMITS) -> DataFrame:
    """Option to the C3 rule: set single out-of-range values to NULL instead of keeping them."""
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c))
                           for c, (lo, hi) in limits.items() if c in df.columns})


# ---------------------------------------------------------------- C4-C6 fills
def interpolate(df: DataFrame, s: Series, cols: Sequence[str] = INTERPOLATED, limit: int = INTERP_LIMIT,
                ffill: int = FFILL_AFTER_INTERP, whole_gap_only: bool = False, forward: Sequence[str] = (),
                forward_limit: int = INDEX_FFILL) -> DataFrame:
    """C4 + C5 (and C6 for the columns of ``forward``, in the same pass): linear interpolation over row position for interior gaps, at most ``limit``
    rows from the gap start, then forward fill of ``ffill`` more rows.

    For a NULL at position r with last non-NULL p and next non-NULL q, k = r - p:
    k <= limit -> v_p + (v_q - v_p)/(q - p)*k; limit < k <= limit+ffill -> the value at
    p+limit; trailing NULLs get v_p for k <= ffill; leading NULLs stay NULL.
    ``whole_gap_only`` fills only gaps of at most ``limit`` rows, entirely, and no ffill.
    """
    cols, forward = _present(df, cols), [c for c in _present(df, forward) if c not in cols]
    keep = POS in df.columns
    d = with_neighbours(df, s, [*cols, *forward], keep_pos=True, prev_only=forward)
    new = {c: F.coalesce(F.col(c), F.when(F.col(POS) - F.col(f"_prev_{c}")["p"] <= forward_limit, F.col(f"_prev_{c}")["v"]))
           for c in forward}
    for c in cols:
        v = F.col(c)
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        p, vp, q, vq = prev["p"], prev["v"], nxt["p"], nxt["v"]
        k = F.col(POS) - p
        inside = prev.isNotNull() & nxt.isNotNull()
        slope = (vq - vp) / (q - p).cast("double")
        if whole_gap_only:
            new[c] = F.when(v.isNotNull(), v.cast("double")).when(inside & (q - p - 1 <= limit), slope * k + vp)
        else:
            new[c] = (F.when(v.isNotNull(), v.cast("double"))
                      .when(inside & (k <= limit), slope * k + vp)
                      .when(inside & (k <= limit + ffill), slope * F.lit(limit) + vp)
                      .when(prev.isNotNull() & nxt.isNull() & (k <= ffill), vp))
    out = d.withColumns(new).drop(*[f"_prev_{c}" for c in [*cols, *forward]], *[f"_next_{c}" for c in cols])
    return out if keep else out.drop(POS)


def ffill(df: DataFrame, s: Series, cols: Sequence[str], limit: int) -> DataFrame:
    """Forward fill with at most ``limit`` consecutive rows."""
    cols = _present(df, cols)
    keep = POS in df.columns

    def build(w):
        return {c: F.last(c, True).over(w.rowsBetween(-limit, 0)) for c in cols}

    return window_apply(df, s, build, before=limit, keep_pos=keep)


def fill_report(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing per channel before and after, percent filled (NULL when none was missing), TOTAL row."""
    cols = [c for c in cols if c in before.columns and c in after.columns]

    def nulls(df, tag):
        wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
        wide = wide.withColumn("TOTAL", sum((F.col(c) for c in cols), F.lit(0).cast("long")))
        return wide.unpivot([], [*cols, "TOTAL"], "channel", tag)

    b, a = nulls(before, "missing_before"), nulls(after, "missing_after")
    j = b.join(a, "channel")
    return j.withColumn("percent_filled",
                        safe_div(F.col("missing_before") - F.col("missing_after"), "missing_before") * 100.0)


# ---------------------------------------------------------------- C8-C11 time consistency
def dup_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that repeat an earlier key, and keys that repeat."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
                 F.count(F.when(F.col("_n") > 1, 1)).alias("duplicate_keys"))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Keep the first row of each key by an explicit total order.

    ``row_number() == 1`` lets Spark plan a partial top-1 before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def sort_series(df: DataFrame, s: Series) -> DataFrame:
    """Total sort by keys and order (range-partitioned)."""
    return df.orderBy(*s.keys, *s.order)


def gap_report(df: DataFrame, s: Series, ts: str = "ts", limit: str = GAP_LIMIT) -> DataFrame:
    """C11: per key the number of steps, steps longer than ``limit`` and the longest step (hours)."""
    lim = F.lit(_interval_micros(limit))

    def build(w):
        return {"_step": F.timestamp_diff("MICROSECOND", F.lag(ts, 1).over(w), F.col(ts))}

    cols = list(dict.fromkeys([*s.keys, *s.order, ts]))
    d = window_apply(df.select(*cols), s, build, before=1)
    return d.groupBy(*s.keys).agg(
        F.count("_step").alias("steps"),
        F.count(F.when(F.col("_step") > lim, 1)).alias("gaps_over_limit"),
        (F.max("_step") / F.lit(3.6e9)).alias("max_gap_hours"))


def _interval_micros(limit: str) -> int:
    n, unit = limit.split()
    per = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
           "day": 86400, "days": 86400}[unit.lower()]
    return int(float(n) * per * 1_000_000)


# ---------------------------------------------------------------- C12-C19 reports and repairs
def _row_nulls(cols):
    return sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))


def quality_report(before: DataFrame, after: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows before/after, percent kept, missing cells before/after, time range after; one pass."""
    cols_b = [c for c in before.columns]
    cols_a = [c for c in after.columns]
    tagged = (before.select(F.lit(0).alias("_side"), _row_nulls(cols_b).alias("_nulls"),
                            F.col(ts).alias("_ts"))
              .unionByName(after.select(F.lit(1).alias("_side"), _row_nulls(cols_a).alias("_nulls"),
                                        F.col(ts).alias("_ts"))))
    r = tagged.agg(
        F.count(F.when(F.col("_side") == 0, 1)).alias("rows_before"),
        F.count(F.when(F.col("_side") == 1, 1)).alias("rows_after"),
        F.coalesce(F.sum(F.when(F.col("_side") == 0, F.col("_nulls"))), F.lit(0)).alias("missing_before"),
        F.coalesce(F.sum(F.when(F.col("_side") == 1, F.col("_nulls"))), F.lit(0)).alias("missing_after"),
        F.min(F.when(F.col("_side") == 1, F.col("_ts"))).alias("first_ts"),
        F.max(F.when(F.col("_side") == 1, F.col("_ts"))).alias("last_ts"))
    return r.withColumn("percent_kept", safe_div("rows_after", "rows_before") * 100.0)


def completeness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Percent of non-missing values per column, long form."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    long = wide.unpivot(["_rows"], cols, "column", "missing")
    return long.select("column", "missing", ((F.lit(1.0) - safe_div("missing", "_rows")) * 100.0)
                       .alias("completeness"))


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C14: +-inf (and NaN) to NULL in floating columns."""
    cols = set(cols) if cols is not None else set(floating_columns(df))
    return df.selectExpr(*[finite_or_null_sql(c) if c in cols else f"`{c}`" for c in df.columns])


def high_missing(df: DataFrame, fraction: float = HIGH_MISSING_FRACTION, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with more than ``fraction`` missing."""
    rep = missing_table(df, cols)
    return rep.where(F.col("missing") > F.col("rows") * F.lit(float(fraction)))


def missing_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    long = wide.unpivot(["rows"], cols, "column", "missing")
    return long.withColumn("percent", safe_div("missing", "rows") * 100.0)


def fill_all(df: DataFrame, s: Series, cols: Sequence[str], default: float = 0.0, backward: bool = True) -> DataFrame:
    """Forward fill, then backward fill, then a constant, per series (unbounded).  The backward fill looks ahead
    in time; ``backward=False`` leaves it out."""
    cols = _present(df, cols)
    keep = POS in df.columns
    d = with_neighbours(df, s, cols, keep_pos=True)
    d = d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_prev_{c}")["v"],
                                     *([F.col(f"_next_{c}")["v"]] if backward else []), F.lit(float(default)))
                       for c in cols})
    d = d.drop(*[f"_prev_{c}" for c in cols], *[f"_next_{c}" for c in cols])
    return d if keep else d.drop(POS)


def feature_consistency(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C17: missing count and percent per column with its type."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    rep = missing_table(df, cols)
    type_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return rep.withColumn("dtype", type_map[F.col("column")])


_INT_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647)]
FLOAT32_MAX = 3.4028234663852886e38


def narrow_plan(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C18 (plan): per numeric column its min, max and the narrowest type that holds them
    strictly inside the type's limits; one aggregate."""
    cols = list(cols or numeric_columns(df))
    types = dict(df.dtypes)
    wide = df.agg(*[x for c in cols for x in (F.min(c).cast("double").alias(f"{c}__min"),
                                               F.max(c).cast("double").alias(f"{c}__max"))])
    parts = []
    for c in cols:
        lo, hi = F.col(f"{c}__min"), F.col(f"{c}__max")
        t = types[c]
        if t in ("tinyint", "smallint", "int", "bigint"):
            expr = None
            for name, a, b in _INT_RANGES:
                cond = (lo > F.lit(a)) & (hi < F.lit(b))
                expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
            new = expr.otherwise(F.lit(t))
        elif t in ("float", "double"):
            new = F.when((lo > F.lit(-FLOAT32_MAX)) & (hi < F.lit(FLOAT32_MAX)), F.lit("float")).otherwise(F.lit(t))
        else:
            new = F.lit(t)
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), new.alias("narrow_dtype"),
                              lo.alias("min"), hi.alias("max")))
    return wide.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def narrow_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cast numeric columns to the narrow types of ``narrow_plan`` (one small collect)."""
    plan = {r["column"]: r["narrow_dtype"] for r in narrow_plan(df, cols).collect()}
    return df.withColumns({c: F.col(c).cast(t) for c, t in plan.items() if t != dict(df.dtypes)[c]})


def nan_to_num(df: DataFrame, cols: Sequence[str], nan: float = 0.0, posinf: float = 1.0,
               neginf: float = 0.0) -> DataFrame:
    """missing/NaN, +inf, -inf replaced by constants."""
    def fix(c):
        x = F.col(c).cast("double")
        return (F.when(x.isNull() | F.isnan(x), F.lit(float(nan)))
                .when(x == F.lit(float("inf")), F.lit(float(posinf)))
                .when(x == F.lit(float("-inf")), F.lit(float(neginf)))
                .otherwise(x))
    return df.withColumns({c: fix(c) for c in cols})


# ---------------------------------------------------------------- C20 composition
def clean(df: DataFrame, s: Series, limits: Mapping[str, tuple] = RANGE_LIMITS,
          interpolated: Sequence[str] = INTERPOLATED, index_channels: Sequence[str] = INDEX_CHANNELS,
          ts: str = "ts", multi_flag: int = MULTI_FLAG_LIMIT, whole_gap_only: bool = False) -> DataFrame:
    """C20: flags on raw values -> interpolate + ffill -> ffill indices -> drop multi-flag rows
    -> keep the first row per timestamp.  Fills run in input order (``s.order``) before the
    de-duplication, as in the reference.  Returns the cleaned rows (unsorted; sort only where
    a sorted output is needed)."""
    d = flag_ranges(df, limits)
    d = ensure_positions(d, s)
    d = interpolate(d, s, interpolated, whole_gap_only=whole_gap_only, forward=index_channels)
    d = drop_multi_flag(d.drop(POS), multi_flag, limits)
    return dedupe(d, [*s.keys, ts], [F.col(c) for c in s.order])
