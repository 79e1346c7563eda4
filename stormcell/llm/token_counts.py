"""Token counts, edit-aware: a segment tree over each document's pre-tokens; an edit re-encodes what it touches.

A byte-level BPE encodes each pre-token by itself, so a document's token count is a sum over its pre-tokens.
``SegmentTree`` keeps, per pre-token, its characters and tokens, and their sums in an implicit binary tree.  An edit
(start, stop, replacement; code points of the text it is applied to) re-encodes the pre-tokens it touches plus one before
them, and goes on to the right until a boundary falls on an old one again: a pre-token is found from its start, one
character past its end at most decides it, so from there on nothing changes.  Leaves that stay in place are updated in
O(log n); where the number of pre-tokens changes the tree is spliced.

``count_tokens`` counts whole texts; ``apply_edits`` takes a table of edits, any number per document, applies each
document's edits in order and streams them, so a task holds one document and one edit at a time.

Null text: zero tokens, and edits apply to the empty text.  Positions beyond the text are clipped.  Null positions or
replacements count as 0, the text's end and the empty string.  Edits of a document that is missing give no rows; rows that
repeat a doc_id get the edits each.  Other columns are not read.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import groups, map_batches, text_bytes, to_batch

CONTEXT = 1            # pre-tokens before the touched ones that are encoded again
LOOKAHEAD = 8          # pre-tokens after the touched ones that are looked at first; doubled until boundaries meet
_CACHE_ENTRIES = 400_000
_COUNTERS: dict[str, "PreTokenCounter"] = {}


class PreTokenCounter:
    """Pre-tokens of a text and the number of tokens of each (kept, bounded)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, int] = {}

    def count(self, pre_token: str) -> int:
        n = self.known.get(pre_token)
        if n is None:
            if len(self.known) > _CACHE_ENTRIES:
                self.known.clear()
            n = self.known[pre_token] = len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)
        return n


def counter(path: str) -> PreTokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PreTokenCounter(path)
    return _COUNTERS[path]


class SegmentTree:
    """Characters and tokens per pre-token of one text, with subtree sums."""

    def __init__(self, text: str, counts: PreTokenCounter):
        self.text, self.counts = text, counts
        self.encoded = 0
        self._build(*self._measure(text))

    def _measure(self, text: str) -> tuple[list[int], list[int]]:
        found = self.counts.split(text)
        self.encoded += len(found)
        return [len(p) for p in found], [self.counts.count(p) for p in found]

    def _build(self, chars, tokens) -> None:
        self.n = len(chars)
        self.size = 1 << max(0, (self.n - 1).bit_length()) if self.n else 1
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if self.n:
            self.sums[self.size:self.size + self.n, 0] = chars
            self.sums[self.size:self.size + self.n, 1] = tokens
        level = self.size
        while level > 1:
            self.sums[level // 2:level] = self.sums[level:2 * level:2] + self.sums[level + 1:2 * level:2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> np.ndarray:
        return self.sums[self.size:self.size + self.n]

    def find(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``char``; the number of leaves at the end."""
        if char >= self.sums[1, 0]:
            return self.n, int(self.sums[1, 0])
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if char >= start + self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        self.sums[node] = chars, tokens
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, stop: int, replacement: str) -> int:
        """Replace text[start:stop]; gives the pre-tokens encoded for it."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        before = self.encoded
        first, at = self.find(max(0, start - 1))
        for _ in range(CONTEXT):
            if first:
                first -= 1
                at -= int(self.sums[self.size + first, 0])
        text = self.text[:start] + replacement + self.text[stop:]
        shift = len(replacement) - (stop - start)
        last, end = self.find(stop)
        look = LOOKAHEAD
        while True:
            upto = min(self.n, last + look)
            ends = end + np.cumsum(self.leaves()[last:upto, 0])        # old boundaries after the edit
            far = int(ends[-1]) if len(ends) else len(self.text)
            whole = upto >= self.n
            if whole:
                far = len(self.text)
            part = text[at:far + shift]
            found = self.counts.split(part)
            stops = at + np.cumsum([len(p) for p in found], dtype=np.int64)
            old = set((np.r_[end, ends] + shift).tolist())
            limit = len(text) if whole else far + shift - 2             # a cut part's last pre-tokens are not certain
            meet = next((k for k, z in enumerate(stops.tolist())
                         if z >= start + len(replacement) and z in old and (z <= limit)), None)
            if meet is not None or whole:
                break
            look *= 2
        kept = found if meet is None else found[:meet + 1]
        until = len(text) if meet is None else int(stops[meet])
        stop_leaf = self.n if until >= len(text) else self.find(until - shift)[0]
        chars, tokens = [len(p) for p in kept], [self.counts.count(p) for p in kept]
        self.encoded += len(kept)
        if len(kept) == stop_leaf - first:
            for k, (c, t) in enumerate(zip(chars, tokens)):
                self._set(first + k, c, t)
        else:
            old_leaves = self.leaves()
            self._build(np.r_[old_leaves[:first, 0], chars, old_leaves[stop_leaf:, 0]].astype(np.int64),
                        np.r_[old_leaves[:first, 1], tokens, old_leaves[stop_leaf:, 1]].astype(np.int64))
        self.text = text
        return self.encoded - before


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_pre_tokens, n_tokens) of every row."""
    schema = "doc_id long, n_pre_tokens long, n_tokens long"

    def run(b):
        c = counter(tokenizer)
        n, t = [], []
        for data in b.column(1).to_pylist():
            found = c.split((data or b"").decode("utf-8", "replace"))
            n.append(len(found))
            t.append(sum(map(c.count, found)))
        return to_batch(schema, (b.column(0), n, t))
    return map_batches(text_bytes(docs), run, schema, text="text")


def apply_edits(docs: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, seq, n_tokens, encoded): token count after each edit and the pre-tokens encoded for it.

    ``edits``: (doc_id, seq, start, stop, replacement).  A document's edits are a sequence and stay together; they stream.
    """
    todo = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"),
                        F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
                        "replacement", F.lit(None).cast("binary").alias("text"), F.lit(0).cast("long").alias("row"))
    known = text_bytes(docs).where("doc_id is not null")
    w = Window.partitionBy("doc_id").orderBy("text")
    known = known.withColumn("row", F.row_number().over(w).cast("long"))
    copies = known.select("doc_id", "row")
    todo = todo.drop("row").join(copies, "doc_id")
    heads = known.select("doc_id", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("start"),
                         F.lit(None).cast("long").alias("stop"), F.lit(None).cast("string").alias("replacement"), "text", "row")
    heads = heads.join(todo.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = (heads.withColumn("head", F.lit(0)).unionByName(todo.withColumn("head", F.lit(1)))
            .repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "head", "seq", "start", "stop", "replacement"))
    schema = "doc_id long, seq long, n_tokens long, encoded long"

    def run(batches):
        c = counter(tokenizer)
        for (doc, _), part in groups(batches, ["doc_id", "row"]):
            tree, cols = None, [[], [], [], []]
            for r in part:
                if not r["head"]:
                    tree = SegmentTree((r["text"] or b"").decode("utf-8", "replace"), c)
                    continue
                stop = len(tree.text) if r["stop"] is None else r["stop"]
                done = tree.edit(r["start"] or 0, stop, r["replacement"] or "")
                for col, x in zip(cols, (doc, r["seq"], tree.tokens, done)):
                    col.append(x)
            if cols[0]:
                yield to_batch(schema, cols)
    return rows.mapInArrow(run, schema)


def edited_counts(docs: DataFrame, tokenizer: str, script) -> DataFrame:
    """Counts before and after each document's own edits, in one pass without a shuffle.

    ``script(text)`` gives a document's edits [(start, stop, replacement), ...].  (doc_id, n_pre_tokens, n_tokens, n_edits,
    n_tokens_after, n_pre_tokens_after, encoded): ``encoded`` counts the pre-tokens encoded for the edits.
    """
    schema = ("doc_id long, n_pre_tokens long, n_tokens long, n_edits int, n_tokens_after long, n_pre_tokens_after long, "
              "encoded long")

    def run(b):
        c = counter(tokenizer)
        cols = [[] for _ in range(7)]
        for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tree = SegmentTree((data or b"").decode("utf-8", "replace"), c)
            n, t = tree.n, tree.tokens
            todo = script(tree.text)
            spent = sum(tree.edit(*e) for e in todo)
            for col, x in zip(cols, (i, n, t, len(todo), tree.tokens, tree.n, spent)):
                col.append(x)
        return to_batch(schema, cols)
    return map_batches(text_bytes(docs), run, schema, text="text")


def middle_edits(text: str) -> list[tuple[int, int, str]]:
    """The query's edits: the text's last 40 characters replace those from its third on, 12 characters go at the
    middle, and its first 5 are put in at two thirds."""
    n = len(text)
    return [(n // 3, min(n, n // 3 + 40), text[-40:]), (n // 2, n // 2 + 12, ""), (2 * n // 3, 2 * n // 3, text[:5])]
