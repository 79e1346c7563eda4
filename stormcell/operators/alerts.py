"""Scoring and alerting."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import alerts as AL
from ..functions.columns import safe_div

MODEL_VERSION = "stormcell-0.1"


class MissingFeatures(ValueError):
    pass


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    """A1: fail before any job when required columns are absent, naming them."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingFeatures(f"missing required features: {missing}")


def decide_profile(df: DataFrame, p: str, profile: str = "PRIMARY", name: str = "decision") -> DataFrame:
    """A3/A4: binary decision with a named threshold profile."""
    return df.withColumn(name, AL.decide(p, AL.THRESHOLD_PROFILES[profile]))


def decide_profiles(df: DataFrame, p: str, profiles: Sequence[str] = tuple(AL.THRESHOLD_PROFILES)) -> DataFrame:
    """A4: every row under several profiles at once (a per-row generate, no join)."""
    arr = F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(AL.THRESHOLD_PROFILES[n]).alias("threshold"))
                    for n in profiles])
    d = df.withColumn("_pr", F.explode(arr)).select("*", "_pr.*").drop("_pr")
    return d.withColumn("decision", AL.decide(p, F.col("threshold")))


def predict_batch(df: DataFrame, p: str, keys: Sequence[str] = (), profile: str = "PRIMARY",
                  detail: bool = False, ts: str | None = None) -> DataFrame:
    """storm_probability, alert_level, prediction text, confidence (+ keys).
    ``detail`` adds time, probability rounded half-even to 4 places, threshold and version (A9).
    Missing columns are named before any job runs (A1)."""
    require_columns(df, [p, *keys, *([ts] if detail and ts else [])])
    t = AL.THRESHOLD_PROFILES[profile]
    cols = [*keys, F.col(p).cast("double").alias("storm_probability"), AL.alert_level(p).alias("alert_level"),
            AL.storm_text(AL.decide(p, t)).alias("prediction"), AL.confidence(p, t).alias("confidence")]
    if detail:
        cols += ([F.col(ts).alias("timestamp")] if ts else []) + [
            F.bround(F.col(p).cast("double"), 4).alias("probability_rounded"), F.lit(t).alias("threshold"),
            F.lit(MODEL_VERSION).alias("model_version")]
    return df.select(*cols)


def alert_distribution(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """A10: count and percent of the six levels, zeros included.  One pass: the counts of a
    group are gathered into a map of at most six levels and read out level by level."""
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, AL.alert_level(p).alias("alert_level")).agg(F.count(F.lit(1)).alias("count"))
    groups = counts.groupBy(*by).agg(F.sum("count").alias("_total"),
                                     F.map_from_entries(F.collect_list(F.struct("alert_level", "count"))).alias("_n"))
    dims = groups.select(*by, "_total", "_n", F.explode(F.array(*[F.lit(x) for x in AL.ALL_LEVELS])).alias("alert_level"))
    j = dims.withColumn("count", F.try_element_at("_n", F.col("alert_level")))
    return j.select(*by, "alert_level", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                    (safe_div(F.coalesce(F.col("count"), F.lit(0)), "_total") * 100.0).alias("percent"))


def first_events(df: DataFrame, y: str, p: str, ts: str, n: int = 10, t: float | None = None,
                 keys: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` actual events in time with score, level and whether the decision matched."""
    thr = AL.THRESHOLD_PROFILES["PRIMARY"] if t is None else t
    ev = df.where(F.col(y) == 1).orderBy(ts, *keys).limit(n)
    return ev.select(*keys, ts, F.col(p).alias("storm_probability"), AL.alert_level(p).alias("alert_level"),
                     AL.decide(p, thr).alias("detected"))
