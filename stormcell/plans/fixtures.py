"""Inputs derived from the driver's tables (FIXTURES.md §3-§4).

* ``raw_panel``: an hourly series with the 14 raw channels, built from ``events``
  (hour x event_type means, masked gaps, spikes and repeated hours).  With
  ``keyed=True`` it is one series per ``user_id`` (observed hours only).
* ``scored_view``: labels and three scores per ``lineitem`` row (stands in for model output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.running import attach_stats
from ..operators.series import reuse

EVENT_TYPES = ["click", "view", "error", "purchase", "signup"]
# Fixed values of the test panel: (offset j, gap g) masks, spike and repeat rules
MASKS = {"click": (0, 9), "view": (1, 6), "error": (2, 7), "purchase": (3, 3), "signup": (4, 2)}
MASK_MOD = 97
MASK_STEP = 7
SPIKE_MOD = 131
SPIKE_AT = 5
SPIKE_FACTOR = 100.0
REPEAT_MOD = 60
# Fixed values of the scored view
BLEND_WEIGHTS = (0.2, 0.5, 0.3)
TRAIN_LAST_YEAR = 1998
VAL_YEAR = 1999
# Panel time split (day of month): train <= 20, validation 21-25, test >= 26
PANEL_TRAIN_LAST_DAY = 20
PANEL_VAL_LAST_DAY = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(c, digits: int):
    """Deterministic decimal rounding floor(x * 10^d + 0.5) / 10^d (same bits in every engine)."""
    m = float(10 ** digits)
    return F.floor(c * F.lit(m) + F.lit(0.5)) / F.lit(m)


def _cells(events: DataFrame, keys) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts")).alias("hour")
    return (events.select(*keys, hour, "event_type", "value")
            .groupBy(*keys, "hour").pivot("event_type", EVENT_TYPES).agg(F.avg("value"))
            .withColumns({t: rnd(F.col(t), 6) for t in EVENT_TYPES}))


def _channels(d: DataFrame, keys) -> DataFrame:
    bz, by, bx = F.col("click") - 50.0, F.col("view") - 50.0, F.col("error") - 50.0
    return d.select(
        *keys, F.col("hour").alias("ts"), "seq",
        F.year("hour").alias("Year"), F.dayofyear("hour").alias("Day"), F.hour("hour").alias("Hour"),
        F.sqrt(bx * bx + by * by + bz * bz).alias("IMF_Magnitude"),
        bz.alias("IMF_Bz"), by.alias("IMF_By"), bx.alias("IMF_Bx"),
        (F.lit(1000.0) + F.lit(1000.0) * F.col("view")).alias("Proton_Temp"),
        (F.lit(0.1) + F.col("signup") / F.lit(5.0)).alias("Proton_Density"),
        (F.lit(200.0) + F.lit(5.0) * F.col("purchase")).alias("Flow_Speed"),
        (F.col("purchase") / F.lit(10.0)).alias("Flow_Pressure"),
        F.floor("click").cast("double").alias("Kp_index"),
        (F.lit(50.0) - F.lit(2.5) * F.col("error")).alias("Dst_index"),
        (F.lit(10.0) * F.col("signup")).alias("AE_index"),
    )


def raw_panel(events: DataFrame, keyed: bool = False) -> DataFrame:
    """Hourly raw series (FIXTURES §3).  Columns: [user_id], ts, seq, Year, Day, Hour, 11 channels."""
    keys = ["user_id"] if keyed else []
    cells = _cells(events, keys)
    h0 = events.agg(F.min(F.date_trunc("hour", F.col("ts"))).alias("h0"),
                    F.max(F.date_trunc("hour", F.col("ts"))).alias("h1"))
    if keyed:
        # observed (user, hour) cells; the hour number n counts from the global first hour
        base = attach_stats(cells, h0.select("h0"))  # one scalar, added as a literal
    else:
        spine = h0.select(F.explode(F.sequence("h0", "h1", F.expr("interval 1 hour"))).alias("hour"), "h0")
        base = spine.repartition("hour").join(cells, on="hour", how="left")
    base = base.withColumn("n", F.timestamp_diff("HOUR", F.col("h0"), F.col("hour"))).drop("h0", "h1")
    spike = F.when(F.pmod(F.col("n"), F.lit(SPIKE_MOD)) == SPIKE_AT, F.lit(SPIKE_FACTOR)).otherwise(F.lit(1.0))
    base = base.withColumns({
        t: F.when(F.pmod(F.col("n") + F.lit(MASK_STEP * j), F.lit(MASK_MOD)) < g, F.lit(None).cast("double"))
        .otherwise(F.col(t) * spike)
        for t, (j, g) in MASKS.items()})
    base = reuse(base)  # feeds both the rows and their repeats
    first = base.withColumn("seq", F.lit(0))
    repeat = (base.where(F.pmod(F.col("n"), F.lit(REPEAT_MOD)) == 0)
              .withColumns({t: F.col(t) + F.lit(1.0) for t in EVENT_TYPES}).withColumn("seq", F.lit(1)))
    return _channels(first.unionByName(repeat), keys)


def panel_split(ts="ts"):
    """Time split of the panel by day of month (stands in for the year split)."""
    d = F.dayofmonth(F.col(ts))
    return (F.when(d <= PANEL_TRAIN_LAST_DAY, F.lit("train"))
            .when(d <= PANEL_VAL_LAST_DAY, F.lit("validation")).otherwise(F.lit("test")))


def scored_view(lineitem: DataFrame) -> DataFrame:
    """Scored rows (FIXTURES §4): y, y2, p1, p2, p3, blend, split."""
    p1 = rnd(F.col("l_discount") * F.lit(10.0), 4)
    p2 = rnd((F.col("l_extendedprice") % F.lit(1000.0)) / F.lit(1000.0), 4)
    p3 = rnd(F.col("l_quantity") / F.lit(50.0), 4)
    d = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                        (F.col("l_returnflag") == "R").cast("int").alias("y"),
                        p1.alias("p1"), p2.alias("p2"), p3.alias("p3"))
    w1, w2, w3 = BLEND_WEIGHTS
    yr = F.year("l_shipdate")
    return d.withColumns({
        "blend": rnd(F.lit(w1) * F.col("p1") + F.lit(w2) * F.col("p2") + F.lit(w3) * F.col("p3"), 6),
        "y2": ((F.col("p2") + F.lit(0.3) * F.col("p1")) > F.lit(0.8)).cast("int"),
        "split": F.when(yr <= TRAIN_LAST_YEAR, "train").when(yr == VAL_YEAR, "validation").otherwise("test"),
    })
