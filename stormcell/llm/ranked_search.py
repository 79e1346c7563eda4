"""Ranked lexical search: hybrid of term-at-a-time and document-at-a-time scoring over document-partitioned shards.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.  A query item's score of a
document sums ``w * ((1000000000 * tf) div (1000 * tf + 20 * m))`` over the item's terms, all in 64-bit integers (see ``impacts``).

1. Items are dealt into blocks of about ``TERMS_PER_BLOCK`` (item, term) pairs; a block's terms go to every task, its size is
   known before.  Documents are read once per block.
2. ``index``: tasks turn runs of documents (at most ``SHARD_DOCUMENTS`` or ``SHARD_POSTINGS``) into shards: posting lists of
   the block's terms, documents' term counts.  No shuffle; document frequencies, N and L are partial aggregates over the shards.
3. ``search``: a task streams its shards and keeps the best documents of every item, so that later shards start with the
   threshold of earlier ones.  In a shard, an item's short lists are summed term at a time into accumulators (``SHORT``).  The
   accumulators then are one more sorted iterator, bounded by their largest sums, beside the long lists: document windows
   whose bounds (of all iterators) cannot reach the threshold are skipped; in the others iterators are split by bound into
   those that must hold a candidate and those that are only looked up, largest bound first, until no candidate can reach
   the threshold.  Bounds are sums of true maxima, so nothing that belongs to the result is skipped, ties included.
4. The tasks' best documents are ranked in two steps (per item and group of tasks, then per item).

Null or term-free texts are no documents here (N does not count them); items without terms have no rows.  Rows that
repeat a doc_id are documents each.  Rows of benchmark with one item_id are one item with all their terms; a null item_id is an item.
A null doc_id is ranked after others of its score.  Empty tables: no rows.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, map_batches, release, ship, stage_table, text_bytes, to_batch

TOP = 50
TERMS_PER_BLOCK = 1_000_000
SHARD_DOCUMENTS = 16_384
SHARD_POSTINGS = 2_000_000
SHORT = 32           # a list is short where it holds at most one in SHORT documents of the shard
WINDOW_DOCUMENTS = 512
TASK_GROUPS = 64     # groups of tasks in the first ranking step
_NO_ID = np.iinfo(np.int64).max
#: What ends a term becomes a space; A-Z become a-z.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(data: bytes | None) -> list[bytes]:
    """The terms of UTF-8 bytes."""
    return data.translate(_FOLD).split() if data else []


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term), each pair once; terms as bytes."""
    schema = "item_id long, term binary"

    def run(b):
        for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = list(dict.fromkeys(terms_of(data)))
            if found:
                yield to_batch(schema, ([i] * len(found), found))
    rows = items.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text"))
    return map_batches(rows, run, schema, text="text").distinct()


_INDEX = "docs binary, sizes binary, terms binary, starts binary, postings binary, counts binary, n_docs long, n_terms long"


def _shard(ids, sizes, hits) -> pa.RecordBatch:
    """One shard: ``hits`` holds per document the numbers of the block's terms that it contains, with repeats."""
    place = np.repeat(np.arange(len(ids)), [len(h) for h in hits])
    term = np.concatenate([np.asarray(h, np.int64) for h in hits]) if hits else np.empty(0, np.int64)
    key, count = np.unique(term * len(ids) + place, return_counts=True)
    term, place = np.divmod(key, max(1, len(ids)))
    known, start = np.unique(term, return_index=True)
    cols = [np.array(ids, np.int64), np.array(sizes, np.int64), known.astype(np.int32), np.r_[start, len(key)].astype(np.int64),
            place.astype(np.int32), count.astype(np.int32)]
    return to_batch(_INDEX, [[c.tobytes()] for c in cols] + [[len(ids)], [int(sum(sizes))]])


def index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Shards of the documents with at least one term; ``number`` gives the block's terms their numbers from 1."""
    rows = text_bytes(docs)

    def run(batches):
        ids, sizes, hits, postings = [], [], [], 0
        get = number.get
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1)):
                words = terms_of(data.as_py())
                if not words:
                    continue
                ids.append(_NO_ID if i is None else i)
                sizes.append(len(words))
                hits.append(np.fromiter(filter(None, map(get, words)), np.int32))
                postings += len(hits[-1])
                if len(ids) >= SHARD_DOCUMENTS or postings >= SHARD_POSTINGS:
                    yield _shard(ids, sizes, hits)
                    ids, sizes, hits, postings = [], [], [], 0
        if ids:
            yield _shard(ids, sizes, hits)
    return rows.mapInArrow(run, _INDEX)


def frequencies(shards: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L and the document frequency of each of the block's terms that occurs."""
    s = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    schema = "term int, df long"

    def run(b):
        for terms, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield to_batch(schema, (np.frombuffer(terms, np.int32), np.diff(np.frombuffer(starts, np.int64))))
    per_shard = map_batches(shards.select("terms", "starts"), run, schema)
    df = per_shard.groupBy("term").agg(F.sum("df").alias("df")).collect()  # at most the block's terms
    return int(s["n"]), int(s["l"]), {r["term"]: r["df"] for r in df}


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document: 100 - 50 + ((50 * n * N) div L)."""
    if len(sizes) and int(sizes.max()) * 50 * n_docs >= 1 << 63:
        return np.array([50 + 50 * s * n_docs // n_terms for s in sizes.tolist()], np.int64)
    return 50 + 50 * sizes * n_docs // max(1, n_terms)


def impacts(w: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Best:
    """The best documents of one item so far: highest scores first, then the least doc_id."""

    __slots__ = ("scores", "ids", "top")

    def __init__(self, top: int = TOP):
        self.top, self.scores, self.ids = top, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """Scores below this cannot enter."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s))[:self.top]
        self.scores, self.ids = s[order], i[order]


class Postings:
    """A sorted iterator over (place, value) with the largest value per document window."""

    __slots__ = ("places", "values", "edges", "bounds")

    def __init__(self, places: np.ndarray, values: np.ndarray, windows: int):
        self.places, self.values = places, values
        self.edges = np.searchsorted(places, np.arange(windows + 1) * WINDOW_DOCUMENTS)
        self.bounds = np.zeros(windows, np.int64)
        some = np.flatnonzero(np.diff(self.edges))
        if len(some):
            self.bounds[some] = np.maximum.reduceat(values, self.edges[some])


class Shard:
    """Posting lists of a shard with their impacts."""

    def __init__(self, row: dict, weights: dict[int, int], n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["docs"], np.int64)
        norms = length_norms(np.frombuffer(row["sizes"], np.int64), n_docs, n_terms)
        terms, starts = np.frombuffer(row["terms"], np.int32).tolist(), np.frombuffer(row["starts"], np.int64).tolist()
        places, counts = np.frombuffer(row["postings"], np.int32), np.frombuffer(row["counts"], np.int32)
        self.windows = -(-len(self.ids) // WINDOW_DOCUMENTS)
        self.short: dict[int, tuple] = {}
        self.long: dict[int, Postings] = {}
        for t, lo, hi in zip(terms, starts, starts[1:]):
            at = places[lo:hi]
            value = impacts(weights[t], counts[lo:hi], norms[at])
            if (hi - lo) * SHORT <= len(self.ids):
                self.short[t] = at, value
            else:
                self.long[t] = Postings(at, value, self.windows)

    def accumulators(self, terms: list[int]) -> Postings | None:
        """The short lists' summed scores, as one bounded iterator."""
        lists = [self.short[t] for t in terms if t in self.short]
        if not lists:
            return None
        places = np.concatenate([p for p, _ in lists])
        order = np.argsort(places, kind="stable")
        places = places[order]
        first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        values = np.concatenate([v for _, v in lists])[order]
        return Postings(places[first], np.add.reduceat(values, first), self.windows)

    def search(self, terms: list[int], best: Best) -> None:
        """Add the shard's documents that belong to the item's best ones."""
        its = [self.long[t] for t in terms if t in self.long]
        summed = self.accumulators(terms)
        if summed is not None:
            its.append(summed)
        if not its:
            return
        bounds = np.stack([p.bounds for p in its])
        reach = bounds.sum(0)
        for w in np.flatnonzero(reach >= max(1, best.least)).tolist():
            if reach[w] >= best.least:
                self._window(w, its, bounds[:, w], best)

    def _window(self, w: int, its: list[Postings], bounds: np.ndarray, best: Best) -> None:
        order = np.argsort(bounds, kind="stable")
        upto = np.cumsum(bounds[order])
        least = best.least
        looked_up = int(np.searchsorted(upto, least))  # these iterators together stay below the threshold
        base = w * WINDOW_DOCUMENTS
        sums = np.zeros(WINDOW_DOCUMENTS, np.int64)
        for k in order[looked_up:].tolist():
            p = its[k]
            lo, hi = p.edges[w], p.edges[w + 1]
            sums[p.places[lo:hi] - base] += p.values[lo:hi]
        rest = int(upto[looked_up - 1]) if looked_up else 0
        at = np.flatnonzero((sums > 0) & (sums + rest >= least))
        score = sums[at]
        for j in range(looked_up - 1, -1, -1):
            if not len(at):
                return
            p = its[order[j]]
            lo, hi = p.edges[w], p.edges[w + 1]
            if lo < hi:
                places = p.places[lo:hi]
                where = np.minimum(np.searchsorted(places, at + base), hi - lo - 1)
                score = score + np.where(places[where] == at + base, p.values[lo:hi][where], 0)
            rest = int(upto[j - 1]) if j else 0
            stay = score + rest >= least
            at, score = at[stay], score[stay]
        if len(at):
            best.add(score, self.ids[at + base])


_HITS = "item_id long, doc_id long, score long"


def search(shards: DataFrame, items: list[tuple], weights: dict[int, int], n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """(item_id, doc_id, score): every task's best documents of every item, given as (item_id, term numbers)."""
    ship(shards.sparkSession)

    def run(batches):
        best = [Best(top) for _ in items]
        for b in batches:
            for row in range(b.num_rows):
                shard = Shard(b.slice(row, 1).to_pylist()[0], weights, n_docs, n_terms)
                for (_, terms), found in zip(items, best):
                    shard.search(terms, found)
        for (item, _), found in zip(items, best):
            if len(found.ids):
                ids = pa.array(found.ids, mask=found.ids == _NO_ID)
                yield to_batch(_HITS, ([item] * len(found.ids), ids, found.scores))
    return shards.mapInArrow(run, _HITS)


def ranked(hits: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the tasks' hits ranked per group of tasks, then over all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.spark_partition_id() % TASK_GROUPS
    some = (hits.withColumn("__part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "__part").orderBy(*order)))
            .where(F.col("rank") <= top))
    last = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return some.select("item_id", last.alias("rank"), "doc_id", "score").where(F.col("rank") <= top)


def top_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    pairs = cut(item_terms(items))
    blocks = max(1, -(-pairs.count() // TERMS_PER_BLOCK))
    out = None
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else pairs
        terms: dict[int | None, list[bytes]] = {}
        for r in mine.collect():  # about TERMS_PER_BLOCK pairs
            terms.setdefault(r["item_id"], []).append(bytes(r["term"]))
        if not terms:
            continue
        number = {t: k for k, t in enumerate(sorted({t for ts in terms.values() for t in ts}), 1)}
        shards = stage_table(index(docs, number), "search-shards")
        n_docs, n_terms, df = frequencies(shards)
        weights = {t: weight(n_docs, n) for t, n in df.items()}
        asked = [(i, [number[t] for t in sorted(ts) if number[t] in weights]) for i, ts in terms.items()]
        hits = ranked(cut(search(shards, asked, weights, n_docs, n_terms, top)), top)
        out = hits if out is None else out.union(hits)
        release(spark)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
