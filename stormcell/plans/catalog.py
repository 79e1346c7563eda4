"""Registered queries: one Spark query per operator group and its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``SQL[name] -> str``.  Every query
reads the driver's tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import normalize
from ..operators import features as FE
from ..operators import quality as Q
from ..operators.series import Series, fitted
from . import fixtures as FX
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DEMO_BLOCK_ROWS = Series.block_rows   # the library default; tests cover block edges with small blocks


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def panel_series(keyed: bool = False) -> Series:
    return Series(keys=("user_id",) if keyed else (), order=("ts", "seq"), block_rows=DEMO_BLOCK_ROWS)


def raw(spark, sf_dir, keyed=False) -> DataFrame:
    return FX.raw_panel(FX.table(spark, sf_dir, "events"), keyed)


def cleaned(spark, sf_dir, keyed=False) -> DataFrame:
    return _cleaned(spark, sf_dir, keyed)[0]


def features(spark, sf_dir, keyed=False) -> DataFrame:
    return FE.build_features(*_cleaned(spark, sf_dir, keyed))


def _cleaned(spark, sf_dir, keyed) -> tuple[DataFrame, Series]:
    d, s = fitted(raw(spark, sf_dir, keyed), panel_series(keyed))
    return Q.clean(d, s), s


PANEL_SPEC = ("ts:t seq:i Year:i Day:i Hour:i IMF_Magnitude:d IMF_Bz:d IMF_By:d IMF_Bx:d Proton_Temp:d "
              "Proton_Density:d Flow_Speed:d Flow_Pressure:d Kp_index:d Dst_index:d AE_index:d")


def _feature_spec(keyed: bool) -> str:
    cols = FE.feature_order(("user_id",) if keyed else ())
    kinds = []
    for c in cols:
        if c == "ts":
            kinds.append("ts:t")
        elif c in ("user_id", "Storm_Binary", "Storm_Intensity", "Storm_Onset"):
            kinds.append(f"{c}:i")
        elif c == "Epsilon_Parameter":
            kinds.append("Epsilon_e15:d")
        else:
            kinds.append(f"{c}:d")
    return " ".join(kinds)


def _features_out(df: DataFrame) -> DataFrame:
    return normalize(df.withColumn("Epsilon_e15", F.col("Epsilon_Parameter") * F.lit(1e15)).drop("Epsilon_Parameter"))


def _features_sql(keyed: bool) -> str:
    inner = (O.with_ctes(O.panel_ctes(keyed), O.clean_ctes(keyed), O.feature_ctes(keyed))
             + " SELECT * EXCLUDE (Epsilon_Parameter), Epsilon_Parameter * 1e15 AS Epsilon_e15 FROM features")
    return O.norm(inner, _feature_spec(keyed))


@register("panel_raw", O.norm(O.with_ctes(O.panel_ctes()) + " SELECT * FROM panel", PANEL_SPEC))
def q_panel_raw(spark, sf_dir):
    """S11-S13 + fixture: the raw hourly series."""
    return normalize(raw(spark, sf_dir))


@register("c20_clean", O.norm(O.with_ctes(O.panel_ctes(), O.clean_ctes()) + " SELECT * FROM cleaned", PANEL_SPEC))
def q_clean(spark, sf_dir):
    """C1 + C3 + C4 + C5 + C6 + C9 + C20 on one long series."""
    return normalize(cleaned(spark, sf_dir))


@register("c20_clean_users", O.norm(O.with_ctes(O.panel_ctes(True), O.clean_ctes(True)) + " SELECT * FROM cleaned",
                                    "user_id:i " + PANEL_SPEC))
def q_clean_users(spark, sf_dir):
    """C20 per user series (keyed)."""
    return normalize(cleaned(spark, sf_dir, keyed=True))


@register("p20_features", _features_sql(False))
def q_features(spark, sf_dir):
    """The 93-column feature table."""
    return _features_out(features(spark, sf_dir))


@register("p20_features_users", _features_sql(True))
def q_features_users(spark, sf_dir):
    """P20 per user series."""
    return _features_out(features(spark, sf_dir, keyed=True))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split of the feature table: rows, storm rate, mean coupling, time range."""
    f = features(spark, sf_dir).withColumn("split", FX.panel_split())
    out = f.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("Storm_Binary").alias("storm_rate"),
        F.avg("Newell_Coupling").alias("mean_newell"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return normalize(out)


_FLAGSHIP_SQL = O.norm(
    O.with_ctes(O.panel_ctes(), O.clean_ctes(), O.feature_ctes())
    + " SELECT CASE WHEN day(ts) <= 20 THEN 'train' WHEN day(ts) <= 25 THEN 'validation' ELSE 'test' END AS split,"
      " count(*) AS rows, avg(Storm_Binary) AS storm_rate, avg(Newell_Coupling) AS mean_newell,"
      " min(ts) AS first_ts, max(ts) AS last_ts FROM features GROUP BY 1",
    "split:s rows:i storm_rate:d mean_newell:d first_ts:t last_ts:t")
register("flagship_split_summary", _FLAGSHIP_SQL)(flagship)


# further registrations live next to their subject
from . import catalog_eval  # noqa: E402,F401
from . import catalog_series  # noqa: E402,F401
from . import catalog_models  # noqa: E402,F401
from . import catalog_extra  # noqa: E402,F401
