"""Parts that the two linear classifiers share: bounded labelled samples, packed features, scoring of every text."""

from __future__ import annotations

from typing import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, text_bytes, to_batch

BITS = 18
SAMPLE_PER_CLASS = 10_000
_CACHE_ENTRIES = 400_000


def held_out(fold: int, mod: int):
    """crc32 of the doc_id as text, modulo ``mod``, equals ``fold``; a row without doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == fold, F.lit(False))


def labelled_sample(labels: DataFrame, column: str, fold: int, mod: int, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, label): at most ``per_class`` rows of each label outside the held-out fold, by hash."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & ~held_out(fold, mod)).dropna().distinct())
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].union(parts[1])


def packed_features(docs: DataFrame, sample: DataFrame, features: Callable) -> list:
    """Rows (doc_id, label, sorted feature numbers) of the sampled documents; the sample is bounded, so it is broadcast."""
    picked = text_bytes(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")

    def run(b):
        idx = [np.array(sorted(features(d)), np.int32).tobytes() for d in b.column(1).to_pylist()]
        return to_batch("doc_id long, label int, idx binary", (b.column(0), b.column(2), idx))
    rows = map_batches(picked, run, "doc_id long, label int, idx binary", text="text").collect()
    return [(r["doc_id"], r["label"], np.frombuffer(r["idx"], np.int32)) for r in sorted(rows, key=lambda r: (r["doc_id"], r["idx"]))]


class HashedNumbers(dict):
    """Feature string -> hashed number; remembers a bounded number of strings."""

    def __missing__(self, key: str) -> int:
        if len(self) > _CACHE_ENTRIES:
            self.clear()
        n = self[key] = xxhash.xxh3_64_intdigest(key.encode()) & ((1 << BITS) - 1)
        return n


def score_all(docs: DataFrame, features: Callable, weights: np.ndarray, to_score: Callable, fold: int, mod: int,
              threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row from its linear score; ``weights`` has a fixed size."""
    def run(b):
        z = [float(weights[np.fromiter(f, np.int64, len(f))].sum()) for f in map(features, b.column(1).to_pylist())]
        return to_batch("doc_id long, score double", (b.column(0), to_score(np.array(z))))
    scored = map_batches(text_bytes(docs), run, "doc_id long, score double", text="text")
    return scored.select("doc_id", held_out(fold, mod).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
