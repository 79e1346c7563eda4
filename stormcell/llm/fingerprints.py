"""Document fingerprints: SimHash with permuted block tables.

``fingerprint``: every two-word term of a text votes, with its count as weight, on 128 bits by the bits of its hash; a text
of one word has that word as term.  Equal texts have equal fingerprints.  Likeness is ``max(0, 1 - 2 * h / 128)`` for ``h``
differing bits: 1 for equal fingerprints, about 0 for unrelated ones.

``with_neighbours``: the documents in descending doc_id order, each with the next one (after the last, the first).
Ranges of doc_id are cut at approximate quantiles and sorted inside a range; the first row of a range is also sent to
the range before it.  The cuts and first ids (one pair per range, about ``BYTES_PER_RANGE`` of text) reach the driver.
The text is shuffled once.

``within_radius``: all fingerprints within a Hamming radius ``r`` of a query.  The bits are cut in ``r + 1`` blocks; a
fingerprint within the radius agrees on a block at least.  Table ``j`` is keyed by block ``j`` (the permutation that puts it
first); candidates of all tables are compared in full.  Equal fingerprints are one entry, so groups of copies cost nothing.
This holds while a block is wide enough to be selective (radius 7: 16 bits).

``NEAR_RADIUS`` follows from a Jaccard similarity of 0.75 of the 5-word shingles: a copy with one changed block keeps about
86 % of its two-word terms, one with scattered edits 94 %.  A bit differs with chance angle / pi, so the block copy differs in
22 bits with a deviation of 4; two deviations are added.  No choice of blocks that must agree stays selective there (radius
30 with 4-bit blocks that agree twice: 496 tables keyed by 8 bits), so ``count_within`` compares every distinct query
fingerprint with every distinct fingerprint, in array steps, and only sums leave a task.  Its work is rows times queries;
the distinct query fingerprints (16 bytes each) reach the driver and every task.

Null text: empty, fingerprint of no votes (all zeros).  Rows that share a doc_id follow each other by content.  Rows without
doc_id have no place in the order: no edited text, no likeness.  One row: it is its own next.  Other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import U64, groups, map_batches, mix, ngram_hashes, release, text_bytes, to_batch, total_bytes, word_hashes, words_of

BITS = 128
RADIUS = 7
NEAR_RADIUS = 30
BYTES_PER_RANGE = 6_000_000


def fingerprint(data: bytes | None) -> bytes:
    """16 bytes."""
    hw = word_hashes(words_of(data))
    terms = ngram_hashes(hw, 2) if len(hw) > 1 else hw
    if not len(terms):
        return bytes(BITS // 8)
    term, weight = np.unique(terms, return_counts=True)
    both = np.column_stack([mix(term), mix(term ^ U64(0x5851F42D4C957F2D))])
    votes = np.zeros(BITS, np.float64)
    for lo in range(0, len(term), 8192):
        bits = np.unpackbits(both[lo:lo + 8192].view(np.uint8), axis=1).astype(np.float32)
        votes += weight[lo:lo + 8192].astype(np.float32) @ bits
    return np.packbits(2 * votes > weight.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    differing = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, 1 - 2 * differing / BITS)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text (or all)."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _ranges(docs: DataFrame) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Cut points of doc_id, and for each range's largest id the range before it (in descending order, round about)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna()
    n = max(1, -(-total_bytes(docs) // BYTES_PER_RANGE))
    cuts = np.unique(np.array(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else [], np.float64))

    @pandas_udf("long")
    def range_of(x):
        import pandas as pd
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), side="left"))
    heads = sorted((r["head"], r["r"]) for r in ids.groupBy(range_of("doc_id").alias("r")).agg(F.max("doc_id").alias("head")).collect())
    before: dict[int, list[int]] = {}
    for k, (head, _) in enumerate(heads):
        before[head] = [heads[(k + 1) % len(heads)][1]]
    return cuts, before


def with_neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    cuts, before = _ranges(docs)
    keys = np.array(sorted(before), np.int64)
    goes = np.array([before[k][0] for k in keys.tolist()], np.int64)

    @pandas_udf("array<long>")
    def ranges_of(x):
        import pandas as pd
        ids = x.to_numpy()
        own = np.searchsorted(cuts, ids, side="left")
        at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
        return pd.Series([[o, g] if k == i else [o] for o, g, k, i in zip(own, goes[at], keys[at], ids)])

    known = text_bytes(docs).where("doc_id is not null")
    rows = (known.select("doc_id", "text", F.posexplode(ranges_of("doc_id")).alias("halo", "rng"))
            .repartition("rng").sortWithinPartitions("rng", "halo", F.desc("doc_id"), F.desc("text")))
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches):
        for _, part in groups(batches, ["rng"]):
            cols, last, done = [[] for _ in range(7)], None, False
            for r in part:
                if done:
                    continue
                data = r["text"] or b""
                here = (r["doc_id"], data.decode("utf-8", "replace"), fingerprint(data))
                if last:
                    made = edited(last[1], here[1]).encode()
                    print_ = fingerprint(made)
                    for c, x in zip(cols, (last[0], len(last[1]), sha256(made).hexdigest(), last[2].hex(), print_.hex(),
                                           likeness(last[2], print_), likeness(last[2], here[2]))):
                        c.append(x)
                    if len(cols[0]) >= 2000:
                        yield to_batch(schema, cols)
                        cols = [[] for _ in range(7)]
                last, done = here, bool(r["halo"])
            if cols[0]:
                yield to_batch(schema, cols)

    found = rows.mapInArrow(run, schema)

    def alone(b):
        data = [x or b"" for x in b.column(1).to_pylist()]
        return to_batch(schema, (b.column(0), [len(x.decode("utf-8", "replace")) for x in data], None,
                                 [fingerprint(x).hex() for x in data], None, None, None))
    return found.union(map_batches(text_bytes(docs).where("doc_id is null"), alone, schema, text="text"))


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, near, distance): for each distinct query fingerprint (hex), all distinct ones of ``prints`` within
    the radius, itself included where it is there."""
    blocks = radius + 1
    width = BITS // 4 // blocks  # hex digits per block; the last one takes the rest
    if width < 1:
        raise ValueError(f"radius {radius} leaves no block of {BITS} bits")
    cut_at = [(k * width + 1, width if k < radius else BITS // 4 - radius * width) for k in range(blocks)]
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.substring("fingerprint", a, n).alias("block"))
                                 for k, (a, n) in enumerate(cut_at)]))
    entry = prints.select("fingerprint").dropna().distinct().select(F.col("fingerprint").alias("near"), tables.alias("e"))
    asked = queries.select("fingerprint").dropna().distinct().select("fingerprint", tables.alias("e"))
    pairs = asked.select("fingerprint", "e.*").join(entry.select("near", "e.*"), ["t", "block"])
    halves = [(1, 16), (17, 16)]
    as_long = lambda c, a, n: F.conv(F.substring(c, a, n), 16, -10).cast("long")
    distance = sum((F.bit_count(as_long("fingerprint", a, n).bitwiseXOR(as_long("near", a, n))) for a, n in halves), F.lit(0))
    return pairs.select("fingerprint", "near", distance.alias("distance")).where(F.col("distance") <= radius).distinct()


def count_within(prints: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, n_within_radius): for each distinct query fingerprint (hex), the rows of ``prints`` within the radius."""
    asked = queries.select(F.unhex("fingerprint").alias("f")).dropna().distinct().toArrow().column("f").to_pylist()
    asked = np.frombuffer(b"".join(asked), U64).reshape(-1, 2) if asked else np.empty((0, 2), U64)
    entry = (prints.select(F.unhex("fingerprint").alias("f")).dropna().groupBy("f").agg(F.count(F.lit(1)).alias("n")))
    schema = "fingerprint string, n long"

    def run(batches):
        found = np.zeros(len(asked), np.int64)
        for b in batches:
            e = np.frombuffer(b"".join(b.column(0).to_pylist()), U64).reshape(-1, 2) if b.num_rows else np.empty((0, 2), U64)
            n, high, low = np.asarray(b.column(1), dtype=np.int64), e[:, 0].copy(), e[:, 1].copy()
            for k, (x, y) in enumerate(asked):
                near = np.flatnonzero(np.bitwise_count(high ^ x) + np.bitwise_count(low ^ y) <= radius)
                if near.size:
                    found[k] += n[near].sum()
        hit = np.flatnonzero(found)
        for lo in range(0, len(hit), 10_000):
            part = hit[lo:lo + 10_000]
            yield to_batch(schema, ([asked[k].tobytes().hex() for k in part], found[part]))
    return entry.mapInArrow(run, schema).groupBy("fingerprint").agg(F.sum("n").alias("n_within_radius"))


def fingerprints(docs: DataFrame, radius: int = RADIUS, every: int = 50) -> DataFrame:
    """``with_neighbours`` and, for documents whose doc_id is divisible by ``every``, the number of documents (itself
    included) within the radius (``n_within_radius``; null for others)."""
    from .common import cut
    found = cut(with_neighbours(docs))
    release(docs.sparkSession)
    queries = found.where(F.col("doc_id") % every == 0)
    if radius <= RADIUS:
        size = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("fingerprint", "near")
        near = (within_radius(found, queries, radius).join(size, "near").groupBy("fingerprint")
                .agg(F.sum("n").alias("n_within_radius")))
    else:
        near = count_within(found, queries, radius)
    asked = queries.select("doc_id", "fingerprint").distinct().join(near, "fingerprint").select("doc_id", "n_within_radius")
    return found.join(asked, "doc_id", "left")
