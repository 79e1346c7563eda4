"""Row-local physics and calendar features (P1-P11, P13-P19).  Pure expressions, no shuffle.

Column arguments default to the raw channel names of the hourly series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .columns import col, nn_greatest, nn_least

# Physical constants and references that must equal the reference's
MU0 = 4 * math.pi * 1e-7          # permeability of free space
PROTON_MASS = 1.67e-27            # kg
BOLTZMANN = 1.38e-23              # J/K
CYCLE_REFERENCE_YEAR = 1996
CYCLE_YEARS = 11
DAYS_PER_YEAR = 365.25
CLIP_SPEED = 200.0                # km/s, lower clip in the Newell coupling
CLIP_FIELD = 0.1                  # nT, lower clip of field strengths
CLIP_ALFVEN = 1e3                 # m/s, lower clip of the Alfven speed
CLIP_MAG_PRESSURE = 1e-15         # Pa, lower clip of the magnetic pressure

DEG = 180.0 / math.pi


def _deg(c: Column) -> Column:
    return c * F.lit(180.0) / F.lit(math.pi)


def clock_angle(by="IMF_By", bz="IMF_Bz") -> Column:
    """atan2(By, Bz) in degrees."""
    return _deg(F.atan2(col(by), col(bz)))


def cone_angle(bx="IMF_Bx", b="IMF_Magnitude") -> Column:
    """acos(|Bx| / max(B, 0.1)) in degrees; NULL where the ratio leaves [-1, 1]."""
    ratio = F.abs(col(bx)) / nn_greatest(b, CLIP_FIELD)
    return F.when(ratio <= 1.0, _deg(F.acos(ratio)))


def bz_south(bz="IMF_Bz") -> Column:
    """min(Bz, 0)."""
    return nn_least(bz, 0.0)


def bz_north(bz="IMF_Bz") -> Column:
    """max(Bz, 0)."""
    return nn_greatest(bz, 0.0)


def bt_yz(by="IMF_By", bz="IMF_Bz") -> Column:
    """P5: transverse field sqrt(By^2 + Bz^2)."""
    return F.sqrt(col(by) * col(by) + col(bz) * col(bz))


def stability(b="IMF_Magnitude", bt="IMF_Bt_YZ") -> Column:
    """B / (Bt + 0.1)."""
    return col(b) / (col(bt) + F.lit(0.1))


def sin_half_clock(clock="IMF_Clock_Angle") -> Column:
    """sin(theta / 2), theta the clock angle in radians."""
    return F.sin(col(clock) * F.lit(math.pi) / F.lit(180.0) / F.lit(2.0))


def newell_coupling(v="Flow_Speed", bt="IMF_Bt_YZ", clock="IMF_Clock_Angle") -> Column:
    """max(V,200)^(4/3) * max(Bt,0.1)^(2/3) * sin^8(theta/2)."""
    s = sin_half_clock(clock)
    return (F.pow(nn_greatest(v, CLIP_SPEED), F.lit(4.0 / 3.0))
            * F.pow(nn_greatest(bt, CLIP_FIELD), F.lit(2.0 / 3.0))
            * F.pow(s, F.lit(8.0)))


def epsilon_parameter(v="Flow_Speed", bt="IMF_Bt_YZ", clock="IMF_Clock_Angle") -> Column:
    """V*1000 * (Bt*1e-9)^2 * sin^4(theta/2) / mu0 / 1e12."""
    s = sin_half_clock(clock)
    return (col(v) * F.lit(1000.0) * F.pow(col(bt) * F.lit(1e-9), F.lit(2.0)) * F.pow(s, F.lit(4.0))
            / F.lit(MU0) / F.lit(1e12))


def merging_electric_field(v="Flow_Speed", bt="IMF_Bt_YZ", clock="IMF_Clock_Angle") -> Column:
    """P10: V * Bt * sin^2(theta/2) / 1000."""
    s = sin_half_clock(clock)
    return col(v) * col(bt) * F.pow(s, F.lit(2.0)) / F.lit(1000.0)


def viscous_function(v="Flow_Speed", n="Proton_Density") -> Column:
    """V^2 * N."""
    return F.pow(col(v), F.lit(2.0)) * col(n)


def alfven_mach(v="Flow_Speed", b="IMF_Magnitude", n="Proton_Density") -> Column:
    """V*1000 / max(vA, 1000), vA = B*1e-9 / sqrt(mu0 * N*1e6*m_p).

    N = 0 gives an infinite Alfven speed, hence Mach 0; with B = 0 as well
    the value is undefined (NULL).  N < 0 has no square root (NULL).
    """
    rho = col(n) * F.lit(1e6) * F.lit(PROTON_MASS)
    va = col(b) * F.lit(1e-9) / F.sqrt(F.lit(MU0) * rho)
    mach = col(v) * F.lit(1000.0) / nn_greatest(va, CLIP_ALFVEN)
    return (F.when(col(n) > 0, mach)
            .when((col(n) == 0) & (col(b) != 0) & col(v).isNotNull(), F.lit(0.0)))


def plasma_beta(n="Proton_Density", t="Proton_Temp", b="IMF_Magnitude") -> Column:
    """N*1e6*k_B*T / max((B*1e-9)^2 / (2 mu0), 1e-15)."""
    thermal = col(n) * F.lit(1e6) * F.lit(BOLTZMANN) * col(t)
    magnetic = F.pow(col(b) * F.lit(1e-9), F.lit(2.0)) / (F.lit(2.0) * F.lit(MU0))
    return thermal / nn_greatest(magnetic, CLIP_MAG_PRESSURE)


def flow_deflection(by="IMF_By", bx="IMF_Bx") -> Column:
    """atan2(By, Bx) in degrees."""
    return _deg(F.atan2(col(by), col(bx)))


def density_speed_product(n="Proton_Density", v="Flow_Speed") -> Column:
    """N * V."""
    return col(n) * col(v)


def hour_sin(hour="Hour") -> Column:
    return F.sin(F.lit(2 * math.pi) * col(hour) / F.lit(24.0))


def hour_cos(hour="Hour") -> Column:
    return F.cos(F.lit(2 * math.pi) * col(hour) / F.lit(24.0))


def day_sin(day="Day") -> Column:
    return F.sin(F.lit(2 * math.pi) * col(day) / F.lit(DAYS_PER_YEAR))


def day_cos(day="Day") -> Column:
    return F.cos(F.lit(2 * math.pi) * col(day) / F.lit(DAYS_PER_YEAR))


def solar_cycle_phase(year="Year") -> Column:
    """sin(2 pi * ((Year - 1996) mod 11) / 11), with a non-negative modulus."""
    phase = F.pmod(col(year) - F.lit(CYCLE_REFERENCE_YEAR), F.lit(CYCLE_YEARS)) / F.lit(float(CYCLE_YEARS))
    return F.sin(F.lit(2 * math.pi) * phase)
