"""Feature table (P1-P20) and the feature catalogue."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import labels as L
from ..functions import physics as P
from .quality import inf_to_null
from .series import POS, Series, window_apply
from .windows import (LAG_COLUMNS, LAG_STEPS, LEAD_STEPS, ROLLING_COLUMNS, ROLLING_WINDOWS, diff_column,
                      lag_columns, lead_column, rolling_columns)

MEASURED = ["IMF_Magnitude", "IMF_Bz", "IMF_By", "IMF_Bx", "Proton_Temp", "Proton_Density", "Flow_Speed",
            "Flow_Pressure", "Kp_index", "Dst_index", "AE_index"]
CALENDAR_PARTS = ["Year", "Day", "Hour"]


def add_reconnection(df: DataFrame) -> DataFrame:
    """P1-P6 (one projection)."""
    d = df.withColumns({"IMF_Clock_Angle": P.clock_angle(), "IMF_Cone_Angle": P.cone_angle(),
                        "IMF_Bz_South": P.bz_south(), "IMF_Bz_North": P.bz_north(), "IMF_Bt_YZ": P.bt_yz()})
    return d.withColumn("IMF_Stability", P.stability())


def add_coupling(df: DataFrame) -> DataFrame:
    """P7-P11 (needs P1, P5)."""
    return df.withColumns({"Newell_Coupling": P.newell_coupling(), "Epsilon_Parameter": P.epsilon_parameter(),
                           "Merging_Electric_Field": P.merging_electric_field(),
                           "Viscous_Function": P.viscous_function()})


def add_dynamics_local(df: DataFrame) -> DataFrame:
    """P13-P16 (row-local part of the dynamics group; P12 needs a window)."""
    return df.withColumns({"Alfven_Mach": P.alfven_mach(), "Plasma_Beta": P.plasma_beta(),
                           "Flow_Deflection": P.flow_deflection(), "Density_Speed_Product": P.density_speed_product()})


def add_dynamics(df: DataFrame, s: Series) -> DataFrame:
    """P12-P16."""
    d = window_apply(df, s, lambda w: {"Pressure_Gradient": diff_column(w, "Flow_Pressure")}, before=1,
                     keep_pos=POS in df.columns)
    return add_dynamics_local(d)


def add_calendar(df: DataFrame) -> DataFrame:
    """P17-P19."""
    return df.withColumns({"Hour_Sin": P.hour_sin(), "Hour_Cos": P.hour_cos(), "Day_Sin": P.day_sin(),
                           "Day_Cos": P.day_cos(), "Solar_Cycle_Phase": P.solar_cycle_phase()})


def feature_order(keys: Sequence[str] = (), ts: str = "ts", extra: Sequence[str] = ()) -> list[str]:
    """Column order of the feature table (reference creation order)."""
    cols = [*keys, ts, *extra, *MEASURED,
            "IMF_Clock_Angle", "IMF_Cone_Angle", "IMF_Bz_South", "IMF_Bz_North", "IMF_Bt_YZ", "IMF_Stability",
            "Newell_Coupling", "Epsilon_Parameter", "Merging_Electric_Field", "Viscous_Function",
            "Pressure_Gradient", "Alfven_Mach", "Plasma_Beta", "Flow_Deflection", "Density_Speed_Product",
            "Hour_Sin", "Hour_Cos", "Day_Sin", "Day_Cos", "Solar_Cycle_Phase"]
    cols += [f"{c}_lag_{n}h" for c in LAG_COLUMNS for n in LAG_STEPS]
    cols += [f"{c}_{st}_{n}h" for c in ROLLING_COLUMNS for n in ROLLING_WINDOWS for st in ("mean", "std")]
    cols += ["Storm_Binary", "Storm_Intensity", "Dst_Rate", "Storm_Onset", "Storm_6h_Ahead"]
    return cols


def build_features(df: DataFrame, s: Series, ts: str = "ts", extra: Sequence[str] = ()) -> DataFrame:
    """P20: the whole feature table in one plan.

    Row-local physics first, then *one* window pass (one exchange, one sort) for the
    pressure gradient, 25 lags, 32 rolling statistics, Dst rate and the 6-row look-ahead
    label, then labels, calendar parts dropped and +-inf turned into NULL.
    ``df`` must be the cleaned series (one row per timestamp).
    """
    d = add_calendar(add_coupling(add_reconnection(df)))
    d = add_dynamics_local(d)

    def build(w):
        cols = {"Pressure_Gradient": diff_column(w, "Flow_Pressure")}
        cols.update(lag_columns(w))
        cols.update(rolling_columns(w))
        cols["Dst_Rate"] = diff_column(w, "Dst_index")
        cols["Storm_6h_Ahead"] = lead_column(w, L.storm_binary(), LEAD_STEPS).cast("double")
        return cols

    reach = max(max(LAG_STEPS), max(ROLLING_WINDOWS) - 1)
    d = window_apply(d, s, build, before=reach, after=LEAD_STEPS)
    d = d.withColumns({"Storm_Binary": L.storm_binary(), "Storm_Intensity": L.storm_intensity(),
                       "Storm_Onset": L.storm_onset()})
    d = d.select(*feature_order(s.keys, ts, extra))
    return inf_to_null(d)


# Feature catalogue categories by name substring (a name may be in several)
CATEGORY_RULES = [
    ("Original Parameters", "exclude", ["_lag_", "_mean_", "_std_", "Storm", "Clock", "Coupling", "Epsilon", "Mach", "Beta"]),
    ("Magnetic Features", "include", ["Clock", "Cone", "IMF_", "Magnetic"]),
    ("Coupling Functions", "include", ["Coupling", "Epsilon", "Merging", "Viscous"]),
    ("Solar Wind Dynamics", "include", ["Mach", "Beta", "Deflection", "Gradient"]),
    ("Temporal Features", "include", ["Sin", "Cos", "Phase", "Hour", "Day"]),
    ("Lag Features", "include", ["_lag_"]),
    ("Rolling Statistics", "include", ["_mean_", "_std_"]),
    ("Storm Targets", "include", ["Storm"]),
]


def feature_catalog(features: DataFrame, skip: Sequence[str] = ("ts", "Solar_Cycle")) -> DataFrame:
    """(category, feature) for every feature column of a feature table, by name rules."""
    spark = features.sparkSession
    names = spark.createDataFrame([(c,) for c in features.columns if c not in skip], "feature string")
    parts = []
    for cat, mode, subs in CATEGORY_RULES:
        hit = None
        for sub in subs:
            h = F.col("feature").contains(sub)
            hit = h if hit is None else (hit | h)
        cond = ~hit if mode == "exclude" else hit
        parts.append(F.when(cond, F.lit(cat)))
    cats = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return names.select(F.explode(cats).alias("category"), "feature")
