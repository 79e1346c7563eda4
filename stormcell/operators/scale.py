"""Scaling and class weights."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from .labels import EXCLUDED_FROM_FEATURES, TARGET, assert_no_leakage, feature_columns
from .quality import fill_all
from .running import attach_stats, exact_quantiles
from .series import Series
from ..session import cut_lineage

QUARTILES = (0.25, 0.5, 0.75)
DEFAULT_WEIGHT_CAP = 10.0


def fit_robust(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N1 (fit): one row with ``<c>_median`` and ``<c>_iqr`` per column, exact interpolated
    quartiles computed distributed (zero IQR -> 1, as the reference's scaler)."""
    q = exact_quantiles(train, list(cols), list(QUARTILES))
    out = []
    for c in cols:
        iqr = F.col(f"{c}_q2") - F.col(f"{c}_q0")
        out += [F.col(f"{c}_q1").alias(f"{c}_median"),
                F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias(f"{c}_iqr")]
    return q.select(*out)


def apply_robust(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N1 (apply): (x - median) / iqr with statistics of ``fit_robust`` (one row)."""
    d = attach_stats(df, stats)
    d = d.withColumns({c: (F.col(c) - F.col(f"{c}_median")) / F.col(f"{c}_iqr") for c in cols})
    return d.drop(*[f"{c}_median" for c in cols], *[f"{c}_iqr" for c in cols])


def class_weights(df: DataFrame, y: str, cap: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """N2 (+N3 cap): balanced weights n / (k * n_c) per class."""
    g = df.groupBy(*by, y).agg(F.count(F.lit(1)).alias("count"))
    tot = g.groupBy(*by).agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    j = g.join(tot, on=list(by)) if by else attach_stats(g, tot)
    w = F.col("_n") / (F.col("_k") * F.col("count")).cast("double")
    if cap is not None:
        w = F.least(w, F.lit(float(cap)))
    return j.select(*by, F.col(y).alias("class"), "count", w.alias("weight"))


def with_weights(df: DataFrame, weights: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """Row weights from a class-weight table, joined by class (Spark broadcasts it by its measured size)."""
    return df.join((weights.select(F.col("class").alias(y), F.col("weight").alias(name))), on=y, how="left")


def prepare(df: DataFrame, s: Series, split: str = "split", target: str = TARGET,
            exclude: Sequence[str] = EXCLUDED_FROM_FEATURES, cap: float | None = None, checkpoint: bool = True,
            allow: Sequence[str] = ("Dst_index",)):
    """Per split forward/backward/zero fill, robust scaling fit on train, class weights.

    The filled table is checkpointed into the shared checkpoint folder (lineage cut,
    survives executor loss) because statistics, fits and scoring all read it.
    Returns (prepared DataFrame, feature list, scaler statistics, class weights).
    """
    feats = feature_columns(df, exclude, non_features=(*s.keys, *s.order, split))
    assert_no_leakage(feats, allow=allow)  # L7; Dst_index is a model input of the reference all the same
    filled = fill_all(df, s.with_keys(split), feats)
    if checkpoint:
        filled = cut_lineage(filled)
    stats = fit_robust(filled.where(F.col(split) == "train"), feats)
    scaled = apply_robust(filled, stats, feats)
    weights = class_weights(scaled.where(F.col(split) == "train"), target, cap)
    return scaled, feats, stats, weights
