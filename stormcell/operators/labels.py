"""Label operators."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import labels as L
from .series import POS, Series, window_apply
from .windows import diff_column, lead_column

# Columns the production label is derived from or that look ahead
TARGET = "Storm"
EXCLUDED_FROM_FEATURES = ["Storm", "Moderate_Storm", "Kp_actual", "Kp_index"]
LEAKAGE_COLUMNS = ["Storm", "Moderate_Storm", "Kp_actual", "Kp_index", "Dst_index", "Dst_Rate",
                   "Storm_Binary", "Storm_Intensity", "Storm_Onset", "Storm_6h_Ahead"]


def dst_labels(df: DataFrame, dst: str = "Dst_index") -> DataFrame:
    """L1 + L2."""
    return df.withColumns({"Storm_Binary": L.storm_binary(dst), "Storm_Intensity": L.storm_intensity(dst)})


def onset_label(df: DataFrame, s: Series, dst: str = "Dst_index") -> DataFrame:
    """W2 + L3: Dst_Rate and Storm_Onset."""
    d = window_apply(df, s, lambda w: {"Dst_Rate": diff_column(w, dst)}, before=1, keep_pos=POS in df.columns)
    return d.withColumn("Storm_Onset", L.storm_onset("Dst_Rate"))


def ahead_label(df: DataFrame, s: Series, horizon: int = 6, dst: str = "Dst_index",
                name: str = "Storm_6h_Ahead") -> DataFrame:
    """L4: Storm_Binary ``horizon`` rows later (horizon is an argument)."""
    return window_apply(df, s, lambda w: {name: lead_column(w, L.storm_binary(dst), horizon).cast("double")},
                        before=0, after=horizon, keep_pos=POS in df.columns)


def kp_labels(df: DataFrame, kp: str = "Kp_index", scale: float = L.KP_SCALE) -> DataFrame:
    """The corrected table's label columns."""
    d = df.withColumn("Kp_actual", L.kp_actual(kp, scale))
    return d.withColumns({"Storm": L.at_least("Kp_actual", L.KP_STORM),
                          "Moderate_Storm": L.at_least("Kp_actual", L.KP_MODERATE)})


def feature_columns(df: DataFrame, exclude: Iterable[str] = EXCLUDED_FROM_FEATURES,
                    non_features: Iterable[str] = ("ts", "split")) -> list[str]:
    """Every column that is neither excluded nor a key/time column, in table order."""
    ex = set(exclude) | set(non_features)
    return [c for c in df.columns if c not in ex]


def split_features(df: DataFrame, target: str = TARGET, exclude: Iterable[str] = EXCLUDED_FROM_FEATURES,
                   keep: Sequence[str] = ("ts",)) -> tuple[DataFrame, list[str]]:
    """One frame with keys, features and the label; plus the feature list."""
    feats = feature_columns(df, exclude, non_features=set(keep) | {"split"})
    cols = [*[k for k in keep if k in df.columns], *(["split"] if "split" in df.columns else []), *feats, target]
    return df.select(*cols), feats


class LeakageError(ValueError):
    pass


def assert_no_leakage(features: Iterable[str], leakage: Iterable[str] = LEAKAGE_COLUMNS,
                      allow: Iterable[str] = ()) -> None:
    """Fail when a feature is a target, one of its sources or a future column."""
    bad = sorted((set(features) & set(leakage)) - set(allow))
    if bad:
        raise LeakageError(f"leaking feature columns: {bad}")
