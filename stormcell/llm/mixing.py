"""Mixing sources to target weights: temperature mixing.

A source with token share ``s`` gets the weight ``s ** alpha`` (normalised).  ``alpha`` is bisected between 0 (all sources
alike) and 1 (as they are) to the least repetition limit or target entropy asked for.  The token budget is the least that
shows every source at least once (or a given one); a source's budget is its weight of it.

``mix`` takes the tokens of a row as a column.  The query and the pipeline pass ``bpe_tokens``: ids that the pipeline's
tokenizer makes of the text, as ``packing`` writes them, without the closing id.  They are counted in one map pass that
leaves a long per row.  Without a column, ``word_count`` (runs of non-blank characters) stands in: it is no measure of
scripts without spaces, minified or encoded text.

Realisation: an epoch of a source is a permutation of its rows, made of blocks: a row's block and its place inside follow
from a hash of (doc_id, epoch).  Whole epochs take every row; the last, partial one takes blocks in order and cuts the last
block at the row where the budget is met.  So a source is never sorted in one task: tokens are summed per block,
a window runs over blocks, and only the cutting block's rows are looked at one by one.  One row per source says where it is cut.

A null source is a source of its own.  Empty documents have no tokens and go where their block goes.  Rows that share a
doc_id share a place.  Empty table: no rows.  All columns are kept; the output adds ``mix_epoch``, ``mix_block``, ``mix_place``,
which replace columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.running import running_totals
from .common import cut, join_hot_keys, ship

BLOCK_TOKENS = 200_000
BROADCAST_SOURCES = 200_000  # rows of a plan (one per source, some 60 bytes) that are sent to every task
STEPS = 4      # sections of the search, each with POINTS candidates
POINTS = 32
REPEAT_LIMIT = 1.5


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bpe_tokens(spark: SparkSession, tokenizer: str, text: str = "text") -> Column:
    """Token ids of the text under a byte-level BPE file; null text: none."""
    ship(spark)

    @pandas_udf("long")
    def count(texts):
        import pandas as pd

        from .packing import encoder
        count = encoder(tokenizer).count
        return pd.Series([count((x or b"").decode("utf-8", "replace")) for x in texts], dtype="int64")
    return count(F.col(text).cast("binary"))


def _bracket(shares: DataFrame, value, wanted: float, rising: bool) -> float:
    """Narrow [0, 1] around the exponent where ``value(candidates)`` meets ``wanted``; gives the end that satisfies it."""
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        points = [lo + (hi - lo) * k / POINTS for k in range(POINTS + 1)]
        got = value(shares, points)
        ok = [(v >= wanted) if rising else (v <= wanted) for v in got]
        # entropy falls with the exponent (met on the left); repetition falls too (met on the right)
        k = max((i for i, x in enumerate(ok) if x), default=0) if rising else min((i for i, x in enumerate(ok) if x), default=POINTS)
        lo, hi = (points[k], points[min(POINTS, k + 1)]) if rising else (points[max(0, k - 1)], points[k])
    return lo if rising else hi


def _entropies(shares: DataFrame, points: list[float]) -> list[float]:
    z = [F.sum(F.pow("share", F.lit(p))) for p in points]
    x = [F.sum(F.pow("share", F.lit(p)) * F.log("share")) for p in points]
    r = shares.agg(*[c.alias(f"z{k}") for k, c in enumerate(z)], *[c.alias(f"x{k}") for k, c in enumerate(x)]).first()
    return [math.log(r[f"z{k}"]) - p * r[f"x{k}"] / r[f"z{k}"] for k, p in enumerate(points)]


def _repetitions(shares: DataFrame, points: list[float]) -> list[float]:
    """Passes over the most repeated source when every source is seen once at least."""
    r = shares.agg(*[(F.max(F.pow("share", F.lit(p - 1))) / F.min(F.pow("share", F.lit(p - 1)))).alias(f"r{k}")
                     for k, p in enumerate(points)]).first()
    return [r[f"r{k}"] for k in range(len(points))]


def exponent(shares: DataFrame, target_entropy: float | None = None, repeat_limit: float | None = REPEAT_LIMIT) -> float:
    """The exponent that meets the limits asked for; with both, the larger one (the limit on repetition binds)."""
    found = []
    if target_entropy is not None:
        found.append(_bracket(shares, _entropies, target_entropy, True))
    if repeat_limit is not None:
        found.append(_bracket(shares, _repetitions, repeat_limit, False))
    return max(found, default=1.0)


def _with_plan(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Rows with their source's plan: rows are not moved, the plan is broadcast after its rows are counted; with more sources only
    those of less than a thousandth of the rows are joined by key."""
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), key)
    return join_hot_keys(rows, plan, key)


def plan(docs: DataFrame, tokens: Column, source: str = "source", target_entropy: float | None = None,
         repeat_limit: float | None = REPEAT_LIMIT, budget: int | None = None, seed: int = 1) -> DataFrame:
    """(key, epochs, blocks, cut_block, cut_place): per source its whole epochs and where the partial one ends."""
    key = F.coalesce(F.col(source).cast("string"), F.lit("\u0000"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), tokens.cast("long").alias("tokens"))
    small = cut(rows)
    totals = cut(small.groupBy("key").agg(F.sum("tokens").alias("t")))
    shares = totals.where("t > 0")
    all_tokens = shares.agg(F.sum("t").alias("t")).first()["t"] or 0
    if not all_tokens:
        return totals.select("key", F.lit(1).cast("long").alias("epochs"), F.lit(1).cast("long").alias("blocks"),
                             F.lit(None).cast("long").alias("cut_block"), F.lit(None).cast("long").alias("cut_place"))
    shares = shares.withColumn("share", F.col("t") / F.lit(float(all_tokens)))
    alpha = exponent(shares, target_entropy, repeat_limit)
    w = shares.withColumn("w", F.pow("share", F.lit(alpha)))
    s = w.agg(F.sum("w").alias("z"), F.max(F.col("t") / F.col("w")).alias("cover")).first()
    scale = s["cover"] if budget is None else budget / s["z"]
    ratio = F.greatest(F.lit(0.0), F.round(F.lit(scale) * F.col("w") / F.col("t"), 9))
    per_source = cut(w.select("key", "t", F.floor(ratio).cast("long").alias("epochs"),
                              F.floor((ratio - F.floor(ratio)) * F.col("t")).cast("long").alias("rest"),
                              F.greatest(F.lit(1), F.ceil(F.col("t") / BLOCK_TOKENS)).cast("long").alias("blocks")))
    placed = _placed(_with_plan(small, per_source.where("rest > 0"), "key"), F.col("epochs"), seed)
    # a source's blocks are summed up over ranges of (source, block), however many blocks it has
    sums = running_totals(placed.groupBy("key", "mix_block").agg(F.max("rest").alias("rest"), F.sum("tokens").alias("n")),
                          ["key"], "mix_block", ["n"]).withColumn("upto", F.col("_before_n") + F.col("n"))
    last = (sums.where("upto > rest").groupBy("key").agg(F.min_by(F.struct("mix_block", (F.col("upto") - F.col("n")).alias("before")),
                                                                  "mix_block").alias("c"))
            .select("key", F.col("c.mix_block").alias("cut_block"), F.col("c.before").alias("before")))
    inside = Window.partitionBy("key").orderBy("mix_place").rangeBetween(Window.unboundedPreceding, 0)
    last = cut(last)
    edge = (_with_plan(placed, last, "key").where("mix_block = cut_block").withColumn("upto", F.col("before") + F.sum("tokens").over(inside))
            .where("upto <= rest").groupBy("key").agg(F.max("mix_place").alias("cut_place")))
    known = per_source.join(last.select("key", "cut_block"), "key", "left").join(edge, "key", "left")
    empty = totals.where("t = 0").select("key", F.lit(1).cast("long"), F.lit(1).cast("long"), F.lit(None).cast("long"),
                                         F.lit(None).cast("long"))
    return known.select("key", "epochs", "blocks", "cut_block", "cut_place").union(empty)


def _placed(df: DataFrame, epoch: Column, seed: int, blocks: str = "blocks") -> DataFrame:
    """Add the row's block and place in the permutation of an epoch; ``blocks`` names the number of blocks of its source."""
    h = F.xxhash64(F.col("doc_id").cast("long"), epoch, F.lit(seed))
    return df.withColumn("mix_block", F.pmod(h, F.col(blocks))).withColumn("mix_place", F.xxhash64(h, F.lit(seed)))


def mix(docs: DataFrame, tokens: Column | None = None, source: str = "source", seed: int = 1, **targets) -> DataFrame:
    """The documents, each as often as its source's budget asks, with mix_epoch, mix_block and mix_place (sort by these three
    for the training order)."""
    tokens = word_count() if tokens is None else tokens
    names = {"key": "__key", "epochs": "__epochs", "blocks": "__blocks", "cut_block": "__cut_block", "cut_place": "__cut_place"}
    p = cut(plan(docs, tokens, source, seed=seed, **targets).withColumnsRenamed(names))
    kept = [c for c in docs.columns if c not in ("mix_epoch", "mix_block", "mix_place")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("__key", F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("\u0000")))
    part = _placed(_with_plan(rows, p, "__key"), F.col("__epochs"), seed, "__blocks")
    in_part = F.coalesce((F.col("mix_block") < F.col("__cut_block"))
                         | ((F.col("mix_block") == F.col("__cut_block")) & (F.col("mix_place") <= F.col("__cut_place"))), F.lit(False))
    copies = F.col("__epochs") + in_part.cast("long")
    out = part.withColumn("__n", copies).where("__n > 0").drop("mix_block", "mix_place")
    out = out.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n").cast("long") - 1)))
    out = _placed(out, F.col("mix_epoch"), seed, "__blocks")
    return out.select(*[F.col(f"`{c}`") for c in kept], "mix_epoch", "mix_block", "mix_place")


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixed rows in the order of the mix: ranges of (mix_epoch, mix_block, mix_place), each sorted, so that the files of a
    table written from it are the training order."""
    by = ["mix_epoch", "mix_block", "mix_place"]
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by)
