"""Time splits, split checks, sampling and metric-history checks."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import safe_div
from .running import nth_value
from .series import POS, Series, ensure_positions, with_neighbours

# The reference's year split (train <= 2016, validation 2017-2020, test >= 2021)
TRAIN_LAST_YEAR = 2016
VAL_LAST_YEAR = 2020
SPLIT_ORDER = ["train", "validation", "test"]
SAMPLE_MULTIPLIER = 2654435761   # arithmetic hash (Knuth) for engine-independent sampling order
HASH_MOD = 1 << 32


def year_split(ts="ts", train_last: int = TRAIN_LAST_YEAR, val_last: int = VAL_LAST_YEAR) -> Column:
    """Split label by calendar year."""
    y = F.year(F.col(ts) if isinstance(ts, str) else ts)
    return F.when(y <= train_last, "train").when(y <= val_last, "validation").otherwise("test")


def split_range(name: str, ts: str = "ts", train_last: int = TRAIN_LAST_YEAR, val_last: int = VAL_LAST_YEAR,
                typ: str = "timestamp_ntz") -> Column:
    """The rows of one year split as a range on the time column, so the filter reaches the
    Parquet scan (a test on ``year(ts)`` cannot be pushed down)."""
    t = F.col(ts)
    lo = {"train": None, "validation": train_last + 1, "test": val_last + 1}[name]
    hi = {"train": train_last + 1, "validation": val_last + 1, "test": None}[name]
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (t >= F.lit(f"{lo}-01-01 00:00:00").cast(typ))
    if hi is not None:
        cond = cond & (t < F.lit(f"{hi}-01-01 00:00:00").cast(typ))
    return cond


def time_split(df: DataFrame, ts: str = "ts", train_last: int = TRAIN_LAST_YEAR, val_last: int = VAL_LAST_YEAR,
               name: str = "split") -> DataFrame:
    """T1."""
    return df.withColumn(name, year_split(ts, train_last, val_last))


def date_split(df: DataFrame, ts: str, val_start: str, test_start: str, name: str = "split") -> DataFrame:
    """Split by date limits (plain comparisons, so filters on one split push down)."""
    t = F.col(ts)
    typ = df.schema[ts].dataType
    v, te = F.lit(val_start).cast(typ), F.lit(test_start).cast(typ)
    return df.withColumn(name, F.when(t < v, "train").when(t < te, "validation").otherwise("test"))


def split_summary(df: DataFrame, label: str, ts: str = "ts", split: str = "split") -> DataFrame:
    """Per split rows, first/last time and label rate."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"),
                                 F.max(ts).alias("last_ts"), F.avg(F.col(label).cast("double")).alias("label_rate"))


def split_overlap(df: DataFrame, ts: str = "ts", split: str = "split", order: Sequence[str] = SPLIT_ORDER) -> DataFrame:
    """T4: for consecutive splits, overlap (max of earlier >= min of later) or the gap in hours."""
    rank = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))])
    b = df.groupBy(split).agg(F.min(ts).alias("_min"), F.max(ts).alias("_max")).withColumn("_rank", rank[F.col(split)])
    w = Window.orderBy("_rank")  # at most len(order) rows
    nxt = b.select(F.col(split).alias("earlier"), F.lead(split).over(w).alias("later"), F.col("_max").alias("earlier_max"),
                   F.lead("_min").over(w).alias("later_min"))
    nxt = nxt.where(F.col("later").isNotNull())
    return nxt.select("earlier", "later", (F.col("earlier_max") >= F.col("later_min")).cast("int").alias("overlap"),
                      (F.timestamp_diff("SECOND", F.col("earlier_max"), F.col("later_min")) / F.lit(3600.0))
                      .alias("gap_hours"))


def value_distribution(df: DataFrame, c: str, by: Sequence[str] = ("split",)) -> DataFrame:
    """T5: count and percent of each value per group."""
    g = df.groupBy(*by, c).agg(F.count(F.lit(1)).alias("count"))
    tot = g.groupBy(*by).agg(F.sum("count").alias("_tot"))
    return g.join(tot, on=list(by)).select(*by, c, "count", (safe_div("count", "_tot") * 100.0).alias("percent"))


def event_rates(df: DataFrame, c: str, limits: Sequence[float] = (4.0, 5.0), by: Sequence[str] = ("split",),
                scale: float = 1.0) -> DataFrame:
    """Per group and limit, events (c/scale >= limit) and their rate; long form."""
    v = F.col(c) / F.lit(float(scale))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, lim in enumerate(limits):
        aggs.append(F.count(F.when(v >= F.lit(float(lim)), 1)).alias(f"_e{i}"))
    wide = df.groupBy(*by).agg(*aggs)
    parts = [F.struct(F.lit(float(lim)).alias("limit"), F.col(f"_e{i}").alias("events")) for i, lim in enumerate(limits)]
    long = wide.select(*by, "rows", F.explode(F.array(*parts)).alias("_x")).select(*by, "rows", "_x.*")
    return long.withColumn("rate", safe_div("events", "rows"))


def sample_key(key: str, seed: int, method: str = "xxhash64") -> Column:
    """Deterministic pseudo-random order key of a row."""
    if method == "mult":
        small = F.pmod(F.col(key).cast("long"), F.lit(1 << 31))  # the product stays within 64 bits
        return F.pmod((small + F.lit(int(seed))) * F.lit(SAMPLE_MULTIPLIER), F.lit(HASH_MOD))
    return F.xxhash64(F.col(key), F.lit(int(seed)))


def sample_exact(df: DataFrame, ratio: float, seed: int, key: str, method: str = "xxhash64") -> DataFrame:
    """Exactly floor(ratio * N) rows without replacement (smallest hash keys), distributed.

    The cut hash value is the n-th smallest one (``nth_value``): only hashes between two sketch bounds are
    ranked, no task sees all rows and nothing is sorted.
    """
    h = df.withColumn("_h", sample_key(key, seed, method))
    n = int(ratio * df.count())
    found = nth_value(h.select("_h"), "_h", ratio, n)
    if found is None:
        return df.where(F.lit(False))
    c, take = found[0], n - found[1]
    below = h.where(F.col("_h") < F.lit(c))
    at = h.where(F.col("_h") == F.lit(c))
    at = at.withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy(key))).where(F.col("_r") <= take) \
        .drop("_r")
    return below.unionByName(at).drop("_h")


def shuffle(df: DataFrame, seed: int, key: str, method: str = "xxhash64", name: str = "shuffle_key") -> DataFrame:
    """A seeded random order (range-partitioned sort by a hash key)."""
    return df.withColumn(name, sample_key(key, seed, method)).orderBy(name, key)


def _uniform(df: DataFrame, key: str | None, seed: int, stream: int, method: str) -> Column:
    """A number strictly between 0 and 1 that depends on the row's key, the seed and the stream only."""
    if method == "mult":
        first = sample_key(key, seed + stream, "mult")
        twice = F.pmod((F.pmod(first, F.lit(1 << 31)) + F.lit(seed + 7 * stream + 1)) * F.lit(SAMPLE_MULTIPLIER), F.lit(HASH_MOD))
        return (twice + F.lit(0.5)) / F.lit(float(HASH_MOD))
    h = F.xxhash64(F.col(f"`{key}`") if key else F.monotonically_increasing_id(), F.lit(seed), F.lit(stream))
    return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def add_noise(df: DataFrame, cols: Sequence[str], sigma: float = 0.01, seed: int = 0, key: str | None = None,
              method: str = "xxhash64") -> DataFrame:
    """Gaussian noise on features, counter-based: Box-Muller over hashes of (key, seed, column), so a row's noise does not
    depend on partitions or on a task being run again.  Without ``key`` the row's place in its partition stands in: then the
    noise is tied to the table's layout."""
    def normal(i):
        radius = F.sqrt(F.lit(-2.0) * F.log(_uniform(df, key, seed, 2 * i, method)))
        return radius * F.cos(F.lit(2.0 * math.pi) * _uniform(df, key, seed, 2 * i + 1, method))
    return df.withColumns({c: F.col(c) + normal(i) * F.lit(float(sigma)) for i, c in enumerate(cols)})


def consecutive_breach(df: DataFrame, s: Series, cond: Column, n: int = 3, start: int = 5,
                       ts: str = "ts") -> DataFrame:
    """Per key, the first row (position >= start) where ``cond`` has held for ``n`` rows in a row.

    Streak length = position - last position where it did not hold (or start - 1),
    taken from the unbounded carry of ``with_neighbours``: no key is windowed in one task.
    """
    d = ensure_positions(df.withColumn("_breach", F.coalesce(cond, F.lit(False))), s)
    d = d.withColumn("_miss", F.when(~F.col("_breach") | (F.col(POS) < start), F.col(POS)))
    d = with_neighbours(d, s, ["_miss"], prev=True, nxt=False, keep_pos=True)
    last_miss = F.greatest(F.coalesce(F.col("_prev__miss")["p"].cast("long"), F.lit(-1)), F.lit(start - 1))
    streak = F.col(POS) - last_miss
    hit = d.where(F.col("_breach") & (F.col(POS) >= start) & (streak >= n))
    return hit.groupBy(*s.keys).agg(F.min(F.struct(F.col(POS).alias("stop_position"), F.col(ts).alias("stop_ts")))
                                    .alias("_s")).select(*s.keys, "_s.*")


def best_row(df: DataFrame, keys: Sequence[str], metric: str, tie: Sequence[str]) -> DataFrame:
    """The row with the least metric per key (ties by ``tie``), by a partial aggregate."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(F.col(metric), *[F.col(t) for t in tie]))
                                 .alias("_b"))
    return best.select(*keys, "_b.*")


def history_verdict(df: DataFrame, train_loss: str, val_loss: str, train_auc: str, val_auc: str,
                    loss_ratio: float = 1.2, auc_gap: float = 0.03) -> DataFrame:
    """T11 verdict: overfitting when val loss > ratio * train loss; else healthy when the AUC gap is small."""
    return df.withColumn(
        "verdict",
        F.when(F.col(val_loss) > F.col(train_loss) * F.lit(loss_ratio), "OVERFITTING")
        .when(F.abs(F.col(train_auc) - F.col(val_auc)) < F.lit(auc_gap), "HEALTHY").otherwise("CHECK"))
