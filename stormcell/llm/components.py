"""Connected components of a link table, as joins and aggregates (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, release


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link; component is the least node reachable.

    Each round is two aggregates (minimum of a node's neighbours, combined before the shuffle) and two joins on
    the node, which Spark splits where one node is hot; rounds grow with the logarithm of the longest chain.
    Only a count and a checksum per round reach the driver.  No links: an empty table.
    """
    e = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    last = None
    while (now := _state(e)) != last:
        last = now
        if not now[0]:
            break
        e = cut(_small(_large(e)))
        release(e.sparkSession)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
