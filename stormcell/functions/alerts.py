"""Alert expressions (A3-A7): decisions, alert levels, confidence and text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import col

# Operating thresholds and alert bands used by the reference's predictor
THRESHOLD_PROFILES = {"PRIMARY": 0.309059, "SECONDARY": 0.455839, "DEFAULT": 0.5}
ALERT_LEVELS = (("CRITICAL", 0.80), ("HIGH", 0.60), ("MODERATE", 0.40), ("LOW", 0.31), ("WATCH", 0.20))
NO_ALERT = "NONE"
HIGH_CONFIDENCE_MARGIN = 0.20
MODERATE_CONFIDENCE_MARGIN = 0.10
STORM_TEXT = "STORM"
NO_STORM_TEXT = "NO STORM"

ALL_LEVELS = tuple(name for name, _ in ALERT_LEVELS) + (NO_ALERT,)


def decide(p, threshold, strict: bool = False) -> Column:
    """M6/A3: 1 when p >= t (blend convention) or p > t (trainer convention, ``strict``)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = col(p) > t if strict else col(p) >= t
    return hit.cast("int")


def alert_level(p) -> Column:
    """A5: graded level by fixed probability bands."""
    expr = None
    for name, lo in ALERT_LEVELS:
        cond = col(p) >= F.lit(lo)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(NO_ALERT))


def confidence(p, threshold) -> Column:
    """HIGH / MODERATE / LOW by strict distance from the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    dist = F.abs(col(p) - t)
    return (F.when(dist > F.lit(HIGH_CONFIDENCE_MARGIN), F.lit("HIGH"))
            .when(dist > F.lit(MODERATE_CONFIDENCE_MARGIN), F.lit("MODERATE"))
            .otherwise(F.lit("LOW")))


def storm_text(decision) -> Column:
    """A7."""
    return F.when(col(decision) == 1, F.lit(STORM_TEXT)).otherwise(F.lit(NO_STORM_TEXT))
