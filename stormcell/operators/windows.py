"""Window operators over row position (W1-W10).  All use the block/halo layout of ``series``."""

from __future__ import annotations

from dataclasses import replace
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col
from .running import attach_stats, exact_quantiles
from .series import POS, Series, ensure_positions, window_apply

# Lag and rolling layout of the engineered feature table
LAG_COLUMNS = ["IMF_Bz", "IMF_Magnitude", "Flow_Speed", "Flow_Pressure", "Newell_Coupling"]
LAG_STEPS = [1, 3, 6, 12, 24]
ROLLING_COLUMNS = ["IMF_Bz", "Flow_Speed", "Dst_index", "Newell_Coupling"]
ROLLING_WINDOWS = [3, 6, 12, 24]
LEAD_STEPS = 6


# ------------------------------------------------------------------ builders (Column factories)
def lag_columns(w: Window, cols: Sequence[str] = LAG_COLUMNS, steps: Sequence[int] = LAG_STEPS) -> dict:
    """``{c}_lag_{n}h`` = value n rows earlier."""
    return {f"{c}_lag_{n}h": F.lag(c, n).over(w) for c in cols for n in steps}


def diff_column(w: Window, c: str) -> Column:
    """First difference to the previous row."""
    return F.col(c) - F.lag(c, 1).over(w)


def rolling_columns(w: Window, cols: Sequence[str] = ROLLING_COLUMNS, windows: Sequence[int] = ROLLING_WINDOWS,
                    stats: Sequence[str] = ("mean", "std")) -> dict:
    """Mean and sample std over the last n rows (min_periods 1; std of one value is NULL)."""
    out = {}
    for c in cols:
        for n in windows:
            frame = w.rowsBetween(-(n - 1), 0)
            if "mean" in stats:
                out[f"{c}_mean_{n}h"] = F.avg(c).over(frame)
            if "std" in stats:
                out[f"{c}_std_{n}h"] = F.stddev_samp(c).over(frame)
    return out


def lead_column(w: Window, c, n: int = LEAD_STEPS) -> Column:
    """Value n rows later (NULL for the last n rows)."""
    return F.lead(col(c), n).over(w)


# ------------------------------------------------------------------ DataFrame operators
def lags(df: DataFrame, s: Series, cols: Sequence[str] = LAG_COLUMNS, steps: Sequence[int] = LAG_STEPS) -> DataFrame:
    """W1."""
    return window_apply(df, s, lambda w: lag_columns(w, cols, steps), before=max(steps),
                        keep_pos=POS in df.columns)


def diff(df: DataFrame, s: Series, c: str, name: str | None = None) -> DataFrame:
    """W2 / P12."""
    return window_apply(df, s, lambda w: {name or f"{c}_diff": diff_column(w, c)}, before=1,
                        keep_pos=POS in df.columns)


def rolling(df: DataFrame, s: Series, cols: Sequence[str] = ROLLING_COLUMNS,
            windows: Sequence[int] = ROLLING_WINDOWS, stats: Sequence[str] = ("mean", "std")) -> DataFrame:
    """W3 + W4."""
    return window_apply(df, s, lambda w: rolling_columns(w, cols, windows, stats), before=max(windows) - 1,
                        keep_pos=POS in df.columns)


def lead_label(df: DataFrame, s: Series, c: str, n: int = LEAD_STEPS, name: str | None = None) -> DataFrame:
    """Look-ahead label, NULL for the last n rows of a series."""
    return window_apply(df, s, lambda w: {name or f"{c}_lead_{n}": lead_column(w, c, n).cast("double")},
                        before=0, after=n, keep_pos=POS in df.columns)


def rolling_fill_median(df: DataFrame, s: Series, cols: Sequence[str], window: int = 24,
                        suffix: str = "_roll") -> DataFrame:
    """Rolling mean of ``window`` rows; what is still missing gets the median of that
    rolling mean over the series (exact, distributed); a series without any value gets 0."""
    names = {c: f"{c}{suffix}" for c in cols}
    d = window_apply(df, s, lambda w: {names[c]: F.avg(c).over(w.rowsBetween(-(window - 1), 0)) for c in cols},
                     before=window - 1, keep_pos=POS in df.columns)
    med = exact_quantiles(d, [names[c] for c in cols], [0.5], keys=s.keys)
    d = attach_stats(d, med, s.keys)
    d = d.withColumns({names[c]: F.coalesce(F.col(names[c]), F.col(f"{names[c]}_q0"), F.lit(0.0)) for c in cols})
    return d.drop(*[f"{names[c]}_q0" for c in cols])


def sequences(df: DataFrame, s: Series, cols: Sequence[str], label: str, length: int, stride: int = 1,
              check_missing: bool = True, ts: str = "ts") -> DataFrame:
    """For every ``stride``-th row i from ``length`` on, the ``length`` rows before i
    (ARRAY<ARRAY<DOUBLE>>, oldest first) with the label of row i; windows that contain a
    missing value are skipped when ``check_missing``.

    Rows are first put together in groups of ``stride`` consecutive rows (one exchange of the input); window m is
    then groups m, m + 1, ... cut to ``length`` rows, read by one array frame over groups in the block/halo layout.  A row
    is shuffled as often as it is in the input, not once per window that contains it, and arrays are only built for
    windows that start a group.
    """
    d = ensure_positions(df.select(*dict.fromkeys([*s.keys, *s.order, ts, *cols, label]),
                                   *([POS] if POS in df.columns else [])), s)
    p = F.col(POS)
    feats = F.array(*[F.col(c).cast("double") for c in cols])
    incomplete = F.when(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) > 0, 1).otherwise(0)
    target = F.when((p >= length) & (F.pmod(p - length, F.lit(stride)) == 0), F.struct(F.col(label).alias("label"), F.col(ts).alias("ts")))
    if stride == 1:
        g = d.select(*s.keys, p.alias(POS), F.array(feats).alias("_f"), F.array(incomplete).alias("_bad"), target.alias("_target"))
    else:
        parts = F.array_sort(F.collect_list(F.struct(p.alias("p"), feats.alias("f"), incomplete.alias("bad"))))
        g = d.groupBy(*s.keys, F.floor(p / F.lit(stride)).alias("_g")).agg(parts.alias("_rows"), F.max(target).alias("_target"))
        g = g.select(*s.keys, F.col("_g").alias(POS), F.transform("_rows", lambda x: x["f"]).alias("_f"),
                     F.transform("_rows", lambda x: x["bad"]).alias("_bad"), "_target")
    frame, ahead = -(-length // stride) - 1, length // stride  # groups after the first one; groups up to the target's

    def build(w):
        rows = w.rowsBetween(0, frame)
        return {"_fs": F.collect_list("_f").over(rows), "_bads": F.collect_list("_bad").over(rows),
                "_t": F.lead("_target", ahead).over(w)}
    at = replace(s, block_rows=max(1, s.block_rows // stride))
    out = window_apply(g, at, build, before=0, after=max(frame, ahead), keep_pos=True).where("_t is not null")
    out = out.withColumn("_w", F.slice(F.flatten("_bads"), 1, length))
    if check_missing:
        out = out.where(~F.array_contains("_w", 1))
    return out.select(*s.keys, F.col("_t.ts").alias(ts), (F.col(POS) * stride + length).alias("position"),
                      F.slice(F.flatten("_fs"), 1, length).alias("sequence"), F.col("_t.label").alias("label"))


def sequences_with_fallback(df: DataFrame, s: Series, cols: Sequence[str], label: str, length: int,
                            stride: int = 3, fallback: int | None = None, ts: str = "ts") -> DataFrame:
    """W7; when it yields nothing, all windows without the missing check (``fallback``: only the first so many,
    where the caller asks for that)."""
    seq = sequences(df, s, cols, label, length, stride, True, ts)
    if seq.limit(1).count() > 0:
        return seq
    raw = sequences(df, s, cols, label, length, 1, False, ts)
    return raw if fallback is None else raw.where(F.col("position") < length + fallback)


def safe_sequences(df: DataFrame, s: Series, cols: Sequence[str], label: str, split_ts, length: int,
                   ts: str = "ts") -> DataFrame:
    """Windows that never straddle the split time.  Rows are sided by ``ts >= split``;
    positions restart on each side; targets are side positions >= ``length``; stride 1."""
    sided = df.withColumn("side", F.when(F.col(ts) >= F.lit(split_ts).cast(df.schema[ts].dataType), "after")
                          .otherwise("before"))
    return sequences(sided, s.with_keys("side"), cols, label, length, 1, False, ts)


def sequence_backfill(df: DataFrame, s: Series, score: str, length: int = 72, head: int = 10,
                      default: float = 0.5, name: str = "sequence_score") -> DataFrame:
    """Per series, rows from ``length`` on keep ``score`` (missing -> ``default``);
    the first ``length`` rows get the mean of the first ``head`` such scores."""
    d = ensure_positions(df, s)
    first = F.when((F.col(POS) >= length) & (F.col(POS) < length + head),
                   F.coalesce(F.col(score).cast("double"), F.lit(float(default))))
    init = d.groupBy(*s.keys).agg(F.avg(first).alias("_init"))
    d = attach_stats(d, init, s.keys)
    val = (F.when(F.col(POS) < length, F.coalesce(F.col("_init"), F.lit(float(default))))
           .otherwise(F.coalesce(F.col(score).cast("double"), F.lit(float(default)))))
    d = d.withColumn(name, val).drop("_init")
    return d if POS in df.columns else d.drop(POS)
