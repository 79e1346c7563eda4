"""Best-fit packing: best-two-fit over the histogram of piece lengths.

1. ``pieces``: every document becomes token ids and a closing id 0; documents over ``CAPACITY`` are cut into full pieces,
   the first one may be shorter.
2. ``best_two_fit``: fill a bin greedily, longest piece that fits first; then replace its smallest piece by the two
   unpacked pieces that fill the freed gap best, if they fill it more tightly.  Pieces of one length are alike, so the plan
   works on how many there are of each length: it makes a bin layout and repeats it as often as the pieces last.
   Only this histogram (at most ``CAPACITY`` rows) reaches the driver; layouts are bounded by the capacity, not by rows.
3. ``assign``: every piece gets its rank among the pieces of its length (counted per block of documents, so a length
   that a third of all pieces share is ranked in many tasks), and the plan says which sequence and offset that rank has.

Null text: an empty document (one id).  Empty table: no rows.  Rows that repeat a (doc_id, piece) are packed each;
they are alike, or ordered by their content's checksum.  Null doc_id: packed like any other.  Other columns are not read.
"""

from __future__ import annotations

import os
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, map_batches, release, text_bytes, to_batch

CAPACITY = 2048
END_ID = 0
PIECES_PER_BLOCK = 200_000   # expected pieces per ranking block over all lengths
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_letters() -> list[str]:
    """The letter that a byte-level BPE writes for each byte: printable Latin-1 stands for itself, the others follow
    from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _ranked(path: str):
    """The vocabulary of a byte-level BPE file as ranks, where its merges are in the order of their ids (else None): then
    merging by rank gives the ids that merging by the list gives."""
    import json

    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], {t["content"] for t in spec.get("added_tokens", ())}
    if model.get("type", "BPE") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        return None
    of = {c: b for b, c in enumerate(_byte_letters())}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    if not all(set(t) <= of.keys() for t in vocab):
        return None
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in made or made != sorted(made) or spec["pre_tokenizer"].get("add_prefix_space"):
        return None
    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, as the tokenizers library gives them for the file, special tokens'
    strings in a text included.

    Texts of ordinary characters without such strings take a quicker encoder of the same ranks; others go through the
    library itself.  Nothing is kept from text to text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = _ranked(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # letter classes may differ between libraries beyond these
        self.unusual = re.compile("|".join(["[^\t\n\r\x20-\x7e\u00a1-\u024f]", *map(re.escape, added)]))

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranked is None or self.unusual.search(text):
            return self.raw(text)
        return np.asarray(self.ranked.encode_ordinary(text), "<u4").tobytes()

    def count(self, text: str) -> int:
        return len(self(text)) // 4


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full pieces, the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): ids as little-endian unsigned 32-bit bytes."""
    schema = _PIECES + ", ids binary" * keep_ids

    def encode(b):
        enc = encoder(tokenizer)
        cols = [[] for _ in range(5 + keep_ids)]
        for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = enc((data or b"").decode("utf-8", "replace")) + np.uint32(END_ID).tobytes()
            for k, (s, n) in enumerate(cut_lengths(len(ids) // 4, capacity)):
                part = ids[4 * s:4 * (s + n)]
                for c, x in zip(cols, (i, k, s, n, crc32(part), part)):
                    c.append(x)
        return to_batch(schema, cols)
    return map_batches(text_bytes(docs), encode, schema, text="text")


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Layouts [(times, [(length, how many per bin), ...])] that use up the histogram {length: pieces}."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    index = np.arange(capacity + 1)
    plan = []
    while left.any():
        free = left.copy()
        floor = np.maximum.accumulate(np.where(free > 0, index, 0))  # longest length at most x that is left
        bin_, gap = [], capacity
        while gap > 0 and (x := int(floor[gap])):
            take = min(gap // x, int(free[x]))
            bin_ += [x] * take
            free[x] -= take
            gap -= take * x
            if not free[x]:
                floor = np.maximum.accumulate(np.where(free > 0, index, 0))
        if len(bin_) > 1 and gap:
            small, room = bin_[-1], bin_[-1] + gap
            a = np.flatnonzero(free[:room] > 0)  # the larger of the two
            b = floor[np.minimum(room - a, a)]
            alone = (b == a) & (free[a] < 2)
            b = np.where(alone, floor[np.maximum(b - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            if len(both) and both.max() > small:
                k = int(both.argmax())
                bin_[-1:] = [int(a[k]), int(b[k])]
        lengths, counts = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // counts).min())
        left[lengths] -= times * counts
        plan.append((times, list(zip(lengths.tolist()[::-1], counts.tolist()[::-1]))))
    return plan


def plan_slots(plan) -> np.ndarray:
    """Rows (length, first rank, how many per bin, first sequence, offset), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, layout in plan:
        offset = 0
        for length, per_bin in layout:
            rank = used.get(length, 0)
            rows.append((length, rank, per_bin, sequence, offset))
            used[length] = rank + times * per_bin
            offset += length * per_bin
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def assign(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (a table that was cut off from its lineage)."""
    total = cut_pieces.count()
    blocks = max(1, total // PIECES_PER_BLOCK)
    keyed = cut_pieces.withColumn("__block", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(blocks)))
    counts = cut(keyed.groupBy("length", "__block").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan_slots(best_two_fit(histogram, capacity))
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (keyed.withColumn("__rank", F.row_number().over(inside) - 1).join(offsets, ["length", "__block"])
              .withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__block", "__before"))
    names = [c for c in cut_pieces.columns]
    ranked = ranked.select(*names, "__rank")
    key = slots[:, 0] * (1 << 40) + slots[:, 1]
    at_length, at_rank = names.index("length"), len(names)

    def place(b):
        import pyarrow as pa
        length = np.asarray(b.column(at_length), dtype=np.int64)
        rank = np.asarray(b.column(at_rank), dtype=np.int64)
        s = slots[np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1]
        nth = rank - s[:, 1]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s[:, 3] + nth // s[:, 2]),
                                           pa.array(s[:, 4] + nth % s[:, 2] * length)],
                                          names=[*names, "sequence_id", "offset"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields)
    return map_batches(ranked, place, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece's place in a sequence."""
    made = cut(pieces(docs, tokenizer, capacity, keep_ids))
    release(docs.sparkSession)
    return assign(made, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences' token ids from a packing that kept them; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("__parts"))
            .select("sequence_id", "n_tokens",
                    F.aggregate("__parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")))
