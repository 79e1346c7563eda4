"""Label expressions (L1, L2, L3, L5).  Missing inputs give the negative class, as in the reference."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import col

# Event limits of the two label definitions
STORM_DST_LIMIT = -50.0            # Storm_Binary: Dst < -50 nT
ONSET_RATE_LIMIT = -30.0           # Storm_Onset: hourly Dst change < -30 nT
# Storm_Intensity classes: >= -30 quiet 0, [-50,-30) weak 1, [-100,-50) moderate 2,
# [-200,-100) strong 3, < -200 severe 4
INTENSITY_EDGES = (-30.0, -50.0, -100.0, -200.0)
KP_SCALE = 10.0                    # Kp is stored as Kp * 10
KP_STORM = 5.0                     # Storm: Kp >= 5
KP_MODERATE = 4.0                  # Moderate_Storm: Kp >= 4


def below(c, limit: float) -> Column:
    """1 if c < limit, else 0 (NULL counts as 0)."""
    return F.coalesce((col(c) < F.lit(float(limit))).cast("int"), F.lit(0))


def at_least(c, limit: float) -> Column:
    """1 if c >= limit, else 0 (NULL counts as 0)."""
    return F.coalesce((col(c) >= F.lit(float(limit))).cast("int"), F.lit(0))


def storm_binary(dst="Dst_index", limit: float = STORM_DST_LIMIT) -> Column:
    """L1."""
    return below(dst, limit)


def storm_intensity(dst="Dst_index", edges=INTENSITY_EDGES) -> Column:
    """L2: class = number of edges the value is below; NULL -> 0."""
    d = col(dst)
    e1, e2, e3, e4 = (F.lit(float(e)) for e in edges)
    return (F.when(d >= e1, 0).when(d >= e2, 1).when(d >= e3, 2).when(d >= e4, 3)
            .when(d < e4, 4).otherwise(0))


def storm_onset(rate="Dst_Rate", limit: float = ONSET_RATE_LIMIT) -> Column:
    """L3: 1 if the hourly change is below the limit."""
    return below(rate, limit)


def kp_actual(kp="Kp_index", scale: float = KP_SCALE) -> Column:
    """Kp as a number."""
    return col(kp) / F.lit(float(scale))
