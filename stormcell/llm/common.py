"""Helpers shared by the operators of this folder: words, rolling hashes, Arrow batches, phase clean-up."""

from __future__ import annotations

import gc
from typing import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage

U64 = np.uint64
# Fixed odd multiplier of the rolling hash; its inverse modulo 2**64 undoes the position.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    from pathlib import Path
    from tempfile import mkdtemp
    from zipfile import ZipFile
    package = Path(__file__).parents[1]
    path = Path(mkdtemp()) / f"{package.name}-{sc.applicationId}.zip"
    with ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def words_of(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes: ``bytes.split`` cuts at exactly these six bytes."""
    return data.split() if data else []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        size = 1 << max(10, n.bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def ngram_hashes(hw: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of ``k`` consecutive word hashes (a polynomial hash over 64-bit word
    hashes, shifted to a common origin by the inverse power, then mixed)."""
    n = len(hw) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    up, down = _powers(len(hw))
    c = np.zeros(len(hw) + 1, U64)
    np.cumsum(hw * up, out=c[1:])
    return mix((c[k:] - c[:-k]) * down[:n] + U64(k))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries, by doubling."""
    span = 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return np.minimum(a[:-rest], a[rest:]) if rest else a


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of ``spark.checkpoint.dir``."""
    return cut_lineage(df)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner free the shuffle files of finished phases (frames that nobody holds any more)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces_of(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text, so that memory per step is bounded."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(bounds, bounds[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
          "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}


def to_batch(schema: str, cols: Iterable) -> pa.RecordBatch:
    """A batch of the columns (lists or arrays; None: all null) under a schema such as ``"doc_id long, n int"``."""
    names, types = zip(*(x.split() for x in schema.split(", ")))
    cols = list(cols)
    n = next((len(c) for c in cols if c is not None), 0)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, _ARROW[t]) if c is None else pa.array(c, _ARROW[t]) if isinstance(c, (list, tuple))
         else (c if isinstance(c, pa.Array) else pa.array(c)).cast(_ARROW[t]) for c, t in zip(cols, types)], names=list(names))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str,
                text: str | None = None) -> DataFrame:
    """``mapInArrow`` over batches; with ``text`` named, over row runs of bounded text size."""
    def run(batches):
        for whole in batches:
            if not whole.num_rows:
                continue
            for b in pieces_of(whole, text) if text else (whole,):
                out = fn(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches, one lazy iterator per run of equal keys (only the current row is held)."""
    from itertools import groupby

    def rows():
        for b in batches:
            for x in b.to_pylist():
                yield x
    return groupby(rows(), key=lambda x: tuple(x[k] for k in keys))


def binary(a: np.ndarray) -> bytes:
    return a.tobytes()


def text_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, text as bytes) of a documents table; whatever else it holds is not read."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def total_bytes(docs: DataFrame) -> int:
    """Bytes of text in the whole table: one partial aggregate, one number."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])


def power_of_two(n: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))))


def join_hot_keys(rows: DataFrame, one_each: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with a table of one row per key.  Keys that hold over 1/``share`` of the rows are ``share`` at most:
    theirs are joined by broadcast, so no task gets all rows of a hot key; the others are joined by shuffle."""
    counts = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    hot = cut(counts.where(F.col("__n") * share > F.lit(total)).where("__n > 100").select(key))
    if hot.isEmpty():
        return rows.join(one_each, key)
    few = cut(one_each.join(F.broadcast(hot), key))
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(one_each, key)
    return rows.join(F.broadcast(few), key).unionByName(cold)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's result as Parquet in the shared folder and read it again."""
    from uuid import uuid4

    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stage-{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
