"""Substring dedup: repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document.  A word goes when a window that covers it has the same words
as a window of a document with a smaller doc_id.

1. ``window_runs``: every window is named by the least hash among its ``PHRASE``-word phrases (its anchor); consecutive
   windows with one anchor are a run (about one per 13 words).  Equal windows have equal anchors, so windows that recur
   lie in runs whose anchor occurs in two documents.
2. ``recurring_runs``: runs whose anchor is met in two or more documents, found by one aggregate (combined before
   the shuffle, so a hot anchor costs a row per task) and one join, which Spark splits where an anchor is hot.
3. ``_segments``: the words of each such run, sent to the shard of its anchor.  An anchor with more than
   ``HOT_OCCURRENCES`` runs is salted over several shards.
4. Shards: the anchors' phrases are confirmed from the text, compiled into an Aho-Corasick automaton over word
   numbers (pyahocorasick), and all segments are streamed through it to locate every occurrence.  The windows around the
   located phrases are compared; the least doc_id of each distinct window decides.  A shard's automaton holds the
   phrases of at most ``SHARD_WORDS`` words of segments.
5. Salted anchors: shards give back their windows with the least doc_id they saw; one aggregate over all of them
   gives the least of all, and a join gives each window its verdict.

Documents without a recurring anchor cannot hold a recurring window and need no streaming.  Nothing is capped: hot anchors
only take another way to the same answer.  Null or blank texts have no window.  Rows without doc_id are never compared and
keep all words.  Rows that repeat a doc_id are not compared with each other (equal ids are not smaller); different texts of one
id are told apart by their content.  Other columns are kept.
"""

from __future__ import annotations

from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from .common import (cut, groups, map_batches, ngram_hashes, release, ship, sliding_min, to_batch, word_hashes, words_of)

WINDOW = 50
PHRASE = 25
HOT_OCCURRENCES = 4096
BROADCAST_IDS = 1_000_000  # doc_ids with different texts that are sent to every task
SHARD_WORDS = 400_000


def told_apart(docs: DataFrame) -> DataFrame:
    """Add ``__copy``: 0, or a hash of the text where other texts have the row's doc_id too.  Spans belong to a doc_id and such a hash,
    so what is found in one text never cuts another one of the same id."""
    here = F.xxhash64(F.col("text").cast("binary"))
    ids = (docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__of")).agg(F.min(here).alias("a"), F.max(here).alias("b"))
           .where("a <> b").select("__of"))
    ids = cut(ids)
    n = ids.count()
    if not n:
        return docs.withColumn("__copy", F.lit(0).cast("long"))
    rows = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("doc_id").cast("long") == F.col("__of"), "left")
    return rows.withColumn("__copy", F.when(F.col("__of").isNotNull(), here).otherwise(0)).drop("__of")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text as bytes, __copy) of rows that are told apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "__copy")


def window_runs(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(anchor, doc_id, copy, start, n, at): ``n`` windows from word ``start`` share the anchor; a phrase lies at word ``at``."""
    def runs(b):
        cols = [[], [], [], [], [], []]
        for i, data, copy in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            words = words_of(data)
            if i is None or len(words) < window:
                continue
            g = ngram_hashes(word_hashes(words), phrase)
            least = sliding_min(g, window - phrase + 1)
            start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            n = np.diff(np.r_[start, len(least)])
            last = start + n - 1
            at = np.array([s + int(np.argmin(g[s:s + window - phrase + 1])) for s in last.tolist()], np.int64)
            for c, x in zip(cols, (least[start].view(np.int64), np.full(len(start), i, np.int64),
                                   np.full(len(start), copy, np.int64), start, n, at)):
                c.append(x)
        if cols[0]:
            yield to_batch(schema, map(np.concatenate, cols))
    schema = "anchor long, doc_id long, copy long, start int, n int, at int"
    return map_batches(_texts(docs), runs, schema, text="text")


def recurring_runs(runs: DataFrame) -> DataFrame:
    """Runs whose anchor occurs in two documents or more, with the number of salts of the anchor."""
    met = (runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("c"))
           .where("lo < hi").select("anchor", F.ceil(F.col("c") / F.lit(HOT_OCCURRENCES)).cast("int").alias("salts")))
    return runs.join(met, "anchor")


def _segments(docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """(anchor, salt, salts, doc_id, copy, start, at, seg): the words of each recurring run, joined by one space."""
    per_doc = marks.groupBy("doc_id", F.col("copy").alias("__copy")).agg(
        F.collect_list(F.struct("anchor", "salts", "start", "n", "at")).alias("runs"))
    both = _texts(docs).where("doc_id is not null").join(per_doc, ["doc_id", "__copy"]).select("doc_id", "text", "__copy", "runs")

    def segments(b):
        cols = [[] for _ in range(8)]
        for i, data, copy, marked in zip(*(b.column(k).to_pylist() for k in range(4))):
            words = words_of(data)
            # rows that repeat an id and its text have their marks repeated too
            for anchor, salts, s, n, at in dict.fromkeys((r["anchor"], r["salts"], r["start"], r["n"], r["at"]) for r in marked):
                for c, x in zip(cols, (anchor, (i * 0x9E3779B1 >> 7) % salts, salts, i, copy, s, at - s, b" ".join(words[s:s + n + window - 1]))):
                    c.append(x)
                if len(cols[0]) >= 20_000:
                    yield to_batch(schema, cols)
                    cols = [[] for _ in range(8)]
        if cols[0]:
            yield to_batch(schema, cols)
    schema = "anchor long, salt int, salts int, doc_id long, copy long, start int, at int, seg binary"
    return map_batches(both, segments, schema, text="text")


def compile_automaton(phrases: list[tuple]) -> ahocorasick.Automaton:
    """Automaton over sequences of word numbers; its values are the phrases' numbers."""
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, p in enumerate(phrases):
        a.add_word(p, k)
    a.make_automaton()
    return a


def _locate(segs: list[tuple], window: int, phrase: int):
    """Windows of the shard's segments that hold a phrase of their own anchor, as located by the automaton:
    arrays (anchor, window hash, segment number, word offset).

    The segments are streamed as one sequence of word numbers with a 0 between them, which no phrase holds."""
    number: dict[bytes, int] = {b" ": 0}
    ids, start, phrases = [], [], {}
    for anchor, at, seg in segs:
        start.append(len(ids))
        ids += [number.setdefault(x, len(number)) for x in seg.split(b" ")]
        first = start[-1] + at
        phrases.setdefault(tuple(ids[first:first + phrase]), anchor)  # a phrase's hash is its anchor
        ids.append(0)
    automaton = compile_automaton(list(phrases))
    hits = np.array(list(automaton.iter(tuple(ids))), np.int64).reshape(-1, 2)
    start = np.array(start)
    size = np.diff(np.r_[start, len(ids)]) - 1
    anchor = np.array([s[0] for s in segs], np.int64)
    q = hits[:, 0] - phrase + 1
    k = np.searchsorted(start, q, side="right") - 1
    mine = np.array(list(phrases.values()), np.int64)[hits[:, 1]] == anchor[k]
    q, k = q[mine], k[mine]
    lo = np.maximum(start[k], q + phrase - window)
    hi = np.minimum(start[k] + size[k] - window + 1, q + 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    some = lo < hi
    np.add.at(edge, lo[some], 1)
    np.add.at(edge, hi[some], -1)
    at = np.flatnonzero(np.cumsum(edge) > 0)
    h = ngram_hashes(word_hashes(list(number))[np.array(ids)], window)[at]
    k = np.searchsorted(start, at, side="right") - 1
    return anchor[k], h, k, at - start[k]


def _spans(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, window: int):
    """Merge window starts of (doc, copy, start), sorted, into (doc, copy, first word, end) spans."""
    if not len(doc):
        return doc, copy, start, start
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] > start[:-1] + 1)])
    last = np.r_[new[1:], len(doc)] - 1
    return doc[new], copy[new], start[new], start[last] + window


_FOUND = "doc_id long, copy long, start int, stop int, window long, least long"


def _shards(segments: DataFrame, window: int, phrase: int) -> DataFrame:
    """Per shard: finished spans of unsalted anchors (window null) and windows of salted ones."""
    rows = segments.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")

    def settle(segs, salted):
        which, h, k, off = _locate([(s[0], s[4], s[5]) for s in segs], window, phrase)
        doc, copy = (np.array([s[j] for s in segs], np.int64)[k] for j in (1, 2))
        start = np.array([s[3] for s in segs], np.int64)[k] + off
        order = np.lexsort((doc, h, which))
        which, h, doc, copy, start = which[order], h[order], doc[order], copy[order], start[order]
        first = np.r_[True, (which[1:] != which[:-1]) | (h[1:] != h[:-1])] if len(h) else np.empty(0, bool)
        least = doc[np.flatnonzero(first)][np.cumsum(first) - 1] if len(h) else doc
        if salted:
            arrays = [doc, copy, start, start + window, h.view(np.int64), least]
        else:
            hit = least < doc
            doc, copy, start = doc[hit], copy[hit], start[hit]
            order = np.lexsort((start, copy, doc))
            arrays = [*_spans(doc[order], copy[order], start[order], window), None, None]
        return to_batch(_FOUND, arrays)

    def run(batches):
        held, size = [], 0
        for (anchor, _), part in groups(batches, ["anchor", "salt"]):
            segs, salted = [], False
            for r in part:
                segs.append((anchor, r["doc_id"], r["copy"], r["start"], r["at"], r["seg"]))
                salted = r["salts"] > 1
            if salted:
                yield settle(segs, True)
                continue
            held += segs
            size += sum(s[5].count(b" ") + 1 for s in segs)
            if size >= SHARD_WORDS:
                yield settle(held, False)
                held, size = [], 0
        if held:
            yield settle(held, False)

    return rows.mapInArrow(run, _FOUND)


def repeated_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, copy, spans): word spans [start, stop) of each document that repeat a document with a smaller doc_id; ``docs``
    are told apart."""
    spark = docs.sparkSession
    runs = window_runs(docs, window, phrase).persist(StorageLevel.DISK_ONLY)
    marks = cut(recurring_runs(runs))
    runs.unpersist()
    release(spark)
    found = cut(_shards(_segments(docs, marks, window), window, phrase))
    release(spark)
    salted = found.where("window is not null")
    least = salted.groupBy("window").agg(F.min("least").alias("of_all"))
    late = salted.join(least, "window").where("of_all < doc_id").select("doc_id", "copy", "start", "stop")
    spans = found.where("window is null").select("doc_id", "copy", "start", "stop").union(late)
    return cut(spans.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))


def removed_words(n: int, spans) -> np.ndarray:
    """Mask of the words inside the spans."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[min(n, s["start"])] += 1
        edge[min(n, s["stop"])] -= 1
    return np.cumsum(edge[:-1]) > 0


def passage_digest(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    docs = told_apart(docs)
    ship(docs.sparkSession)
    spans = repeated_spans(docs, window, phrase).withColumnRenamed("copy", "__copy")
    both = _texts(docs).join(spans, ["doc_id", "__copy"], "left").select("doc_id", "text", "spans")

    def digest(b):
        n, gone, sha = [], [], []
        for data, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            words = words_of(data)
            if s:
                drop = removed_words(len(words), s)
                kept = [w for w, d in zip(words, drop.tolist()) if not d]
            else:
                kept = words
            n.append(len(words))
            gone.append(len(words) - len(kept))
            sha.append(sha256(b" ".join(kept)).hexdigest())
        return to_batch(schema, (b.column(0), n, gone, sha))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return map_batches(both, digest, schema, text="text")


def cut_text(text: str | None, spans) -> str | None:
    """The text without the words of the spans and the white space after them; nothing else changes."""
    if not text or not spans:
        return text
    data = text.encode()
    words = data.split()
    drop = removed_words(len(words), spans)
    out, at, keep_from = [], 0, 0
    for w, d in zip(words, drop.tolist()):
        lo = data.index(w, at)
        if d:
            out.append(data[keep_from:lo])
            hi = lo + len(w)
            while hi < len(data) and data[hi] in b" \t\n\v\f\r":
                hi += 1
            keep_from = hi
        at = lo + len(w)
    out.append(data[keep_from:])
    return b"".join(out).decode()


def without_passages(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """The documents with repeated passages cut from ``text`` (and ``n_chars``, where there is one, counted anew)."""
    schema, apart = docs.schema, told_apart(docs)
    spans = repeated_spans(apart, window, phrase).select(F.col("doc_id").alias("__id"), F.col("copy").alias("__of"), F.col("spans").alias("__spans"))
    both = (apart.join(spans, (F.col("doc_id") == F.col("__id")) & (F.col("__copy") == F.col("__of")), "left")
            .drop("__id", "__of", "__copy"))
    where = both.columns.index("text")
    n_at = both.columns.index("n_chars") if "n_chars" in docs.columns else None

    def rewrite(b):
        texts = [cut_text(t, s) for t, s in zip(b.column(where).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
        cols = list(b.columns[:-1])
        if n_at is not None:
            cut_here = b.column(b.num_columns - 1).is_valid().to_pylist()
            cols[n_at] = pa.array([len(t) if c and t is not None else n for t, c, n in
                                   zip(texts, cut_here, cols[n_at].to_pylist())], cols[n_at].type)
        cols[where] = pa.array(texts, cols[where].type)
        return pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])
    return map_batches(both, rewrite, schema, text="text")
