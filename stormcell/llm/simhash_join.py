"""SimHash near-dedup: pigeonhole blocks.

1. ``fingerprints``: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; every 3-word shingle (repeats
   included; fewer words: the whole sequence) is hashed by XXH64, seed 42.  A bit is set if it is set in over half the hashes.
2. ``block_members``: fingerprints (each distinct one once) are cut into ``BLOCKS`` blocks.  Two that differ in at most
   ``RADIUS`` bits agree in ``BLOCKS - RADIUS`` blocks at least, so they meet under one of the keys that are made of so many blocks.
3. ``links``: fingerprints of one key are compared and pairs within the radius give links.  A key holds at most
   ``KEY_MEMBERS`` fingerprints there; from each such group goes one link per fingerprint to the least one it is connected with.
   Under a key with more members no pairs are made: fingerprints at two bits or fewer share a point that is at most one bit
   from both, so each goes to the points around it (one bit of the other blocks changed, or none), at most 33 fingerprints
   meet at a point, and each is linked with the point's least one and verified.  Both ways give all connections, none is capped.
4. ``components`` of the links over distinct fingerprints; documents take the component of their fingerprint.  Fingerprints
   that hold over a thousandth of all rows (a thousand at most) are joined by broadcast, the others by key.

Null text, empty and blank texts have no words: fingerprint zero, linked like any other.  Rows that repeat a doc_id are
fingerprinted each.  A row without doc_id takes part; if its whole component has no doc_id, component_id is null.  Empty table: no
rows.  Very long texts are hashed in pieces of ``PIECE_BYTES``.  Other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from .common import U64, cut, groups, join_hot_keys, map_batches, release, text_bytes, to_batch
from .components import components

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
BITS = 64
BLOCKS = 4
KEY_MEMBERS = 256
PIECE_BYTES = 1 << 20
_BLANK = b" \t\n\v\f\r"


def _word_pieces(data: bytes, size: int):
    """Lists of the words of ``data``, cut at blanks after about ``size`` bytes each."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in _BLANK:
            end += 1
        yield data[at:end].split()
        at = end


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    total = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[lo:lo + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def _shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    line = b" ".join(words)
    stop = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    start = [0] + [s + 1 for s in stop]
    spans = zip(start, stop[k - 1:])
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in spans), U64, max(0, len(words) - k + 1))


def simhash(text: bytes | None, k: int = SHINGLE_WORDS, piece: int = PIECE_BYTES) -> int:
    """The 64-bit fingerprint of a text's UTF-8 bytes."""
    counts, n, held = np.zeros(BITS, np.int64), 0, []
    for words in _word_pieces((text or b"").lower(), piece):
        held += words
        if len(held) >= k:
            hashes = _shingle_hashes(held, k)
            counts += _set_bits(hashes)
            n += len(hashes)
            held = held[len(held) - k + 1:]
    if not n and held:
        counts, n = _set_bits(np.array([xxh64_intdigest(b" ".join(held), SEED)], U64)), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""
    schema = "doc_id long, fp long"

    def run(b):
        found = np.array([simhash(x, k) for x in b.column(1).to_pylist()], U64)
        return to_batch(schema, (b.column(0), found.view(np.int64)))
    return map_batches(text_bytes(docs), run, schema, text="text")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Bit masks of all choices of ``blocks - radius`` blocks."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    one = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(one, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_members(fps: DataFrame) -> DataFrame:
    """(choice, key, fp): each fingerprint under every choice of blocks."""
    keys = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for i, m in enumerate(block_masks())]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.choice", "k.key", "fp")


def _least_linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each member of a group the least member it is connected with by links of at most ``radius`` bits."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    at = np.arange(len(fps))
    while True:
        down = np.where(near, at[None, :], len(fps)).min(1)
        down = down[down]
        if (down == at).all():
            return fps[at]
        at = down


def _compared(members: DataFrame) -> DataFrame:
    """Links inside keys of few members: every pair of a key is compared, connected ones go to their least one."""
    rows = members.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")

    def run(batches):
        a, b = [], []
        for _, part in groups(batches, ["choice", "key"]):
            fps = np.array([r["fp"] for r in part], np.int64)
            if len(fps) == 2:
                if ((int(fps[0]) ^ int(fps[1])) & (1 << BITS) - 1).bit_count() > RADIUS:
                    continue
                least = fps[:1].repeat(2)
            else:
                least = _least_linked(fps.view(U64), RADIUS).view(np.int64)
            new = least != fps
            a += fps[new].tolist()
            b += least[new].tolist()
            if len(a) > 50_000:
                yield to_batch("a long, b long", (a, b))
                a, b = [], []
        if a:
            yield to_batch("a long, b long", (a, b))
    return rows.mapInArrow(run, "a long, b long")


def _around(members: DataFrame) -> DataFrame:
    """Links inside keys of many members, by the points at one bit or none from each (RADIUS is 2)."""
    flips = [[0] + [_signed(1 << b) for b in range(BITS) if not m >> b & 1] for m in block_masks()]
    points = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in f]) for f in flips]), F.col("choice") + 1)
    near = members.select("choice", "fp", F.explode(F.transform(points, lambda x: x.bitwiseXOR(F.col("fp")))).alias("point"))
    least = F.min("fp").over(Window.partitionBy("choice", "point"))  # at most one fingerprint per bit and one more
    return (near.select(F.col("fp").alias("a"), least.alias("b"))
            .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).distinct())


def links(fps: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints: their connected parts are those of all pairs within the radius."""
    members = block_members(fps)
    sizes = cut(members.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = cut(members.join(sizes, ["choice", "key"]))
    few = _compared(met.where(F.col("n") <= KEY_MEMBERS).drop("n"))
    return few.union(_around(met.where(F.col("n") > KEY_MEMBERS).drop("n")))


def near_components(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the least doc_id reachable."""
    fps = cut(fingerprints(docs, k))
    release(docs.sparkSession)
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = components(cut(links(classes.select("fp")).distinct()), "a", "b").withColumnRenamed("node", "fp")
    known = cut(classes.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = cut(join_hot_keys(known.select("fp", "component"), ids, "component").select("fp", "component_id"))
    found = join_hot_keys(fps, of_fp, "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
