"""N-gram Jaccard join: prefix-tree join over globally ordered shingle sets.

A document's set holds its distinct word shingles (as 64-bit hashes).  Two documents link when
``100 * |A and B| >= percent * |A or B|``.

1. ``document_sets``: size and digest of every set; equal sets are one class, its least doc_id stands for it.
2. ``shared_sets``: how many sets hold each shingle.  Shingles travel as packed arrays per (batch, hash bucket):
   6 bytes each, no row per shingle.  A bucket counts each distinct set once (copies are told by 64 bits of the set's
   digest) and answers its least doc_id with the shingles that other sets hold too and their frequency class;
   documents are put together again per group of documents.  The global order is
   (frequency class, hash), rare first.  A set whose shared shingles are fewer than ``percent`` of it can link
   with nothing and goes; what stays is exact, no link is lost.
3. ``_lists``: two linked sets have a shingle in common among the first ``s - ceil(t n) + 1`` shared ones (prefix
   filter).  Shingles held by the same sets are one list.
4. Stars: each list compares its members with a pivot, the least id; lists that then still lie in several components do
   so with other pivots (by hash), until that finds nothing new.  Components of these links merge large groups of near
   copies without looking at all their pairs.
5. Rest: lists whose other members still lie in several components compare the members outside the list's
   largest component with all members.  Pairs within a component are skipped: they change no component.
6. Comparisons (``trie_links``) run in groups of bounded size: the members of a block are stored as a
   path-compressed trie in global order; a probe walks it once, shares the overlap of common prefixes and leaves a
   subtree when the overlap so far plus what remains (of the probe or of the longest set below) cannot reach the bound.

Nulls: a null or blank text has an empty set and links with nothing.  A row without doc_id gets its set size and a
null component.  Rows that repeat a doc_id with another text are one document whose sets are pooled in step 2.
Other columns are never read.  Shingle equality is judged by 54 to 64 hash bits (48 plus the bucket's).
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import (U64, binary, cut, groups, map_batches, mix, ngram_hashes, power_of_two, release, text_bytes,
                     to_batch, total_bytes, word_hashes, words_of)
from .components import components

SHINGLE_WORDS = 5
PERCENT = 75
BYTES_PER_BUCKET = 12_000_000   # of text; decides only how finely the work is dealt
BLOCK_SETS = 512                # sets in one trie
STAR_ROUNDS = 3                 # at most; what is then open is compared in full


def shingles(data: bytes | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z are lower-cased, no other letter."""
    words = words_of(data.lower()) if data else []
    if not words:
        return np.empty(0, U64)
    hw = word_hashes(words)
    if len(words) < k:
        return ngram_hashes(hw, len(words)) ^ U64(len(words) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return np.unique(ngram_hashes(hw, k))


def document_sets(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n, digest): size of each set and 16 bytes that name it; an empty set is a class of its own."""
    def sets(b):
        ids = b.column(0).to_pylist()
        n, digest = [], []
        for i, data in zip(ids, b.column(1).to_pylist()):
            s = shingles(data, k)
            n.append(len(s))
            digest.append(blake2b(s.tobytes() if len(s) else f"empty {i}".encode(), digest_size=16).digest())
        return to_batch(schema, (ids, n, digest))
    schema = "doc_id long, n long, digest binary"
    return map_batches(text_bytes(docs), sets, schema, text="text")


def _deal(ids: np.ndarray, names: np.ndarray, sets: list[np.ndarray], bits: int):
    """Packed shingles of a batch, one row per hash bucket, in document order."""
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bucket = (tokens >> U64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    tokens, owner, bucket = tokens[order], owner[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, int)
    rows = []
    for lo, hi in zip(starts, np.r_[starts[1:], len(bucket)]):
        first = np.flatnonzero(np.r_[True, owner[lo + 1:hi] != owner[lo:hi - 1]])
        t = tokens[lo:hi]
        at = owner[lo:hi][first]
        rows.append((int(bucket[lo]), binary(ids[at]), binary(names[at]), binary(np.diff(np.r_[first, hi - lo]).astype(np.int32)),
                     binary((t & U64(0xFFFFFFFF)).astype(np.uint32)),
                     binary(((t >> U64(32)) & U64(0xFFFF)).astype(np.uint16))))
    return rows


def _frequency_class(df: np.ndarray) -> np.ndarray:
    """Quarter octaves: 4 to 255 for 2 to 2**63 holders."""
    return np.minimum(255, np.floor(4 * np.log2(df))).astype(np.uint8)


def shared_sets(docs: DataFrame, sets: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, toks): per class representative that can link with anything, its shared shingles in global order."""
    bits = power_of_two(total_bytes(docs) / BYTES_PER_BUCKET, 64, 1 << 24).bit_length() - 1
    n_groups = min(1 << bits, 1 << 16)

    def deal(b):
        best: dict[bytes, tuple[int, np.ndarray]] = {}
        for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = shingles(data, k) if i is not None else ()
            if len(s):  # copies within a batch: the least doc_id speaks for them
                key = blake2b(s.tobytes(), digest_size=16).digest()
                if key not in best or i < best[key][0]:
                    best[key] = (i, s)
        if best:
            ids, arrays = zip(*best.values())
            names = np.frombuffer(b"".join(k[:8] for k in best), U64)
            rows = _deal(np.array(ids, np.int64), names, list(arrays), bits)
            yield to_batch(packed, zip(*rows))

    packed = "bucket int, docs binary, names binary, counts binary, lo binary, hi binary"
    dealt = map_batches(text_bytes(docs), deal, packed, text="text")

    def answer(key, pdf):
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["docs"]])
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["counts"]])
        tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["lo"]]).astype(U64)
        tokens |= np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["hi"]]).astype(U64) << U64(32)
        tokens |= U64(int(key[0])) << U64(64 - bits)
        names = np.concatenate([np.frombuffer(x, U64) for x in pdf["names"]])
        order = np.lexsort((ids, names))  # copies of a set: the least doc_id answers for them
        one = np.zeros(len(ids), bool)
        one[order[np.r_[True, np.diff(names[order]) != 0]]] = True
        tokens = tokens[np.repeat(one, counts)]
        ids, counts = ids[one], counts[one]
        _, inverse, df = np.unique(tokens, return_inverse=True, return_counts=True)
        df = df[inverse]
        keep = df > 1
        owner = np.repeat(np.arange(len(ids)), counts)[keep]
        tokens, code = tokens[keep], _frequency_class(df[keep])
        group = (mix(ids.view(U64)) % U64(n_groups)).astype(np.int32)[owner]
        order = np.argsort(group, kind="stable")
        owner, tokens, code, group = owner[order], tokens[order], code[order], group[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
        out = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(group)]) if len(group) else ():
            first = np.flatnonzero(np.r_[True, owner[lo + 1:hi] != owner[lo:hi - 1]])
            out.append((int(group[lo]), binary(ids[owner[lo:hi][first]]),
                        binary(np.diff(np.r_[first, hi - lo]).astype(np.int32)), binary(tokens[lo:hi]),
                        binary(code[lo:hi])))
        import pandas as pd
        return pd.DataFrame(out, columns=["grp", "docs", "counts", "toks", "codes"])

    answers = dealt.groupBy("bucket").applyInPandas(answer, "grp int, docs binary, counts binary, toks binary, codes binary")
    reps = (sets.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("r"))
            .select("r.doc_id", "r.n"))

    def numbered(b):
        ids = np.asarray(b.column(0), dtype=np.int64)
        grp = (mix(ids.view(U64)) % U64(n_groups)).astype(np.int32)
        return to_batch("grp int, doc_id long, n long", (grp, b.column(0), b.column(1)))

    def assemble(key, left, right):
        import pandas as pd
        rows = []
        size = dict(zip(right["doc_id"], right["n"]))
        if len(left) and size:
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in left["docs"]])
            counts = np.concatenate([np.frombuffer(x, np.int32) for x in left["counts"]])
            names, inverse = np.unique(ids, return_inverse=True)
            total = np.zeros(len(names), np.int64)
            np.add.at(total, inverse, counts)
            n = np.array([size.get(i, 0) for i in names.tolist()])
            able = (n > 0) & (100 * total >= percent * n)
            owner = np.repeat(inverse, counts)
            keep = able[owner]
            owner = owner[keep]
            toks = np.concatenate([np.frombuffer(x, U64) for x in left["toks"]])[keep]
            codes = np.concatenate([np.frombuffer(x, np.uint8) for x in left["codes"]])[keep]
            order = np.lexsort((toks, codes, owner))
            owner, toks = owner[order], toks[order]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, int)
            for lo, hi in zip(starts, np.r_[starts[1:], len(owner)]):
                d = owner[lo]
                rows.append((int(names[d]), int(n[d]), binary(toks[lo:hi])))
        return pd.DataFrame(rows, columns=["doc_id", "n", "toks"])

    named = map_batches(reps, numbered, "grp int, doc_id long, n long")
    return answers.groupBy("grp").cogroup(named.groupBy("grp")).applyInPandas(assemble, "doc_id long, n long, toks binary")


def _prefix(n: int, s: int, percent: int) -> int:
    return s - -(-percent * n // 100) + 1


def _lists(kept: DataFrame, percent: int) -> DataFrame:
    """(tok, pivot, doc) of every member but the pivot: one list per group of prefix shingles that the same sets hold."""
    def prefixes(b):
        ids, toks = [], []
        for i, n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            p = np.frombuffer(t, np.int64)
            p = p[:_prefix(n, len(p), percent)]
            toks.append(p)
            ids.append(np.full(len(p), i, np.int64))
        return to_batch("tok long, doc long", (np.concatenate(toks), np.concatenate(ids)))
    pairs = map_batches(kept, prefixes, "tok long, doc long")
    held = pairs.groupBy("tok").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"),
                                    F.bit_xor(F.xxhash64("doc", F.lit(7))).alias("y"), F.min("doc").alias("pivot")).where("n > 1")
    lists = held.groupBy("n", "x", "y", "pivot").agg(F.min("tok").alias("tok")).select("tok", "pivot")
    return cut(pairs.join(cut(lists), "tok").where("doc <> pivot"))


class _Node:
    __slots__ = ("label", "children", "ends", "least", "most", "below", "tag")


def build_trie(rows: list[tuple]) -> _Node:
    """Path-compressed trie of (toks array, doc, n, component) rows; each node knows the least and largest set size, the
    longest rest below it and, where it is one, the component of all its sets."""
    rows = sorted(rows, key=lambda r: r[0].tobytes())
    lcp = [0] * len(rows)
    for i in range(1, len(rows)):
        a, b = rows[i - 1][0], rows[i][0]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        lcp[i] = int(differ[0]) if len(differ) else m

    root = _Node()
    todo = [(root, 0, len(rows), 0)]
    made = []
    while todo:
        node, lo, hi, depth = todo.pop()
        made.append(node)
        end = min(lcp[lo + 1:hi], default=len(rows[lo][0]))
        if node is root:
            end = 0
        node.label = rows[lo][0][depth:end]
        node.ends = [rows[i] for i in range(lo, hi) if len(rows[i][0]) == end]
        node.children = []
        at = [i for i in range(lo + 1, hi) if lcp[i] == end]
        for x, y in zip([lo, *at], [*at, hi]):
            while x < y and len(rows[x][0]) == end:
                x += 1
            if x < y:
                child = _Node()
                node.children.append(child)
                todo.append((child, x, y, end))
        sizes = [rows[i][2] for i in range(lo, hi)]
        node.least, node.most = min(sizes), max(sizes)
        node.below = max(len(rows[i][0]) for i in range(lo, hi)) - end
        tags = {rows[i][3] for i in range(lo, hi)}
        node.tag = tags.pop() if len(tags) == 1 else None
    return root


def probe_trie(root: _Node, toks: np.ndarray, doc: int, n: int, comp, percent: int = PERCENT) -> list[int]:
    """Docs of the trie that link with the probe (its own component excepted)."""
    order = np.argsort(toks)
    ranked = toks[order]
    found, todo = [], [(root, 0, -1)]
    while todo:
        node, overlap, last = todo.pop()
        if node.tag is not None and node.tag == comp:
            continue
        if 100 * node.most < percent * n or 100 * n < percent * node.least:
            continue
        if len(node.label):
            at = np.searchsorted(ranked, node.label)
            at[at == len(ranked)] = 0
            hit = ranked[at] == node.label
            if hit.any():
                overlap += int(hit.sum())
                last = int(order[at[hit]].max())
        if (100 + percent) * (overlap + min(node.below, len(toks) - last - 1)) < percent * (n + node.least):
            continue
        for _, d, m, c in node.ends:
            if c != comp and d != doc and (100 + percent) * overlap >= percent * (n + m):
                found.append(d)
        todo += [(child, overlap, last) for child in node.children]
    return found


def trie_links(kept: DataFrame, keyed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links found in groups.  ``keyed``: (key, salt, doc, role, comp); role 0 is stored in the group's trie, role 1
    probes it.  A group stores at most a block of sets; probes stream by."""
    rows = keyed.join(kept.withColumnRenamed("doc_id", "doc"), "doc")
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "role")

    def run(batches):
        for _, part in groups(batches, ["key", "salt"]):
            stored, root, a, b = [], None, [], []
            for r in part:
                toks = np.frombuffer(r["toks"], U64)
                if r["role"] == 0:
                    stored.append((toks, r["doc"], r["n"], r["comp"]))
                elif stored:
                    root = root or build_trie(stored)
                    hits = probe_trie(root, toks, r["doc"], r["n"], r["comp"], percent)
                    a += [r["doc"]] * len(hits)
                    b += hits
            if a:
                yield to_batch("a long, b long", (a, b))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _salted(members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Members with a salt so that a (key, salt) block holds about BLOCK_SETS, and the number of salts per key."""
    blocks = members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_SETS)).cast("int").alias("salts"))
    return members.join(blocks, key).withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")), blocks


def _components_of(members: DataFrame, comps: DataFrame | None, doc: str, out: str) -> DataFrame:
    """Members with the component so far of the document in column ``doc``."""
    if comps is None:
        return members.withColumn(out, F.col(doc))
    c = comps.select(F.col("node").alias(doc), F.col("component").alias("__c"))
    return members.join(c, doc, "left").withColumn(out, F.coalesce("__c", doc)).drop("__c")


def _unsettled(members, comps):
    """Members of lists that still lie in two components or more, with their component and the list's largest one."""
    m = _components_of(members.select("tok", "doc"), comps, "doc", "comp")
    sizes = m.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = (sizes.groupBy("tok").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
            .where("comps > 1").select("tok", "main"))
    return cut(m.join(main, "tok"))


def _star_links(kept, pairs, percent):
    """Compare ``doc`` with ``key`` of each pair (components ``comp`` and ``other``) where lengths allow a link."""
    size = kept.select(F.col("doc_id").alias("doc"), "n")
    pairs = (pairs.where("doc <> key and comp <> other").distinct()
             .join(size, "doc").join(size.select(F.col("doc").alias("key"), F.col("n").alias("m")), "key")
             .where(F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")).drop("n", "m"))
    stored, _ = _salted(cut(pairs), "key")
    probes = stored.select("key", "salt", "other").distinct()
    keyed = (stored.select("key", "salt", "doc", F.lit(0).alias("role"), "comp")
             .union(probes.select("key", "salt", F.col("key").alias("doc"), F.lit(1), F.col("other"))))
    return cut(trie_links(kept, keyed, percent))


def _rest_links(kept, open_, percent):
    """Compare the members of unsettled lists outside the lists' largest component with all members.  Lists with one
    largest component are joined, so a set travels once for all of them."""
    m = cut(open_.select(F.col("main").alias("key"), "doc", "comp").distinct())
    stored, blocks = _salted(m, "key")
    probes = (m.where("comp <> key").join(blocks, "key")
              .select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "doc",
                      F.lit(1).alias("role"), "comp"))
    keyed = stored.select("key", "salt", "doc", F.lit(0).alias("role"), "comp").union(probes)
    return cut(trie_links(kept, keyed, percent))


def _all_links(kept: DataFrame, percent: int) -> DataFrame:
    """Links that give the components of the kept sets."""
    open_ = _lists(kept, percent)  # every member but the list's pivot
    pairs = open_.select("doc", F.col("pivot").alias("key"), F.col("doc").alias("comp"), F.col("pivot").alias("other"))
    links = _star_links(kept, pairs, percent)
    for turn in range(1, STAR_ROUNDS + 1):
        release(kept.sparkSession)
        open_ = _unsettled(open_, components(links, "a", "b"))
        if open_.isEmpty():
            break
        pivots = open_.groupBy("tok").agg(F.min_by(F.struct("doc", "comp"), F.xxhash64("doc", F.lit(turn))).alias("p"))
        pairs = open_.join(pivots, "tok").select("doc", F.col("p.doc").alias("key"), "comp", F.col("p.comp").alias("other"))
        new = _star_links(kept, pairs, percent) if turn < STAR_ROUNDS else None
        if new is None or new.isEmpty():
            links = links.union(_rest_links(kept, open_, percent))
            break
        links = links.union(new)
    return links


def jaccard_components(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the least doc_id reachable by links, itself included."""
    spark = docs.sparkSession
    sets = cut(document_sets(docs, k))
    release(spark)
    kept = cut(shared_sets(docs, sets, k, percent))
    release(spark)
    comps = components(_all_links(kept, percent), "a", "b")
    known = sets.where("doc_id is not null")
    classes = (known.groupBy("digest").agg(F.min("doc_id").alias("rep"))
               .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
               .select("digest", F.coalesce("component", "rep").alias("component_id")))
    found = known.join(classes, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.union(sets.where("doc_id is null").select("doc_id", "n", F.lit(None).cast("long")))


def keep_representatives(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without near copies: the least doc_id of each component stays, one row of it (the least row by
    its columns' hash); rows without doc_id stay as they are, and empty texts are nobody's copies."""
    gone = (jaccard_components(docs, k, percent).where("component_id < doc_id").select(F.col("doc_id").alias("__gone"))
            .distinct())
    names = [F.col(f"`{c}`") for c in docs.columns]
    again = (docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(F.col("doc_id").alias("__again")))
    again = cut(again.join(gone, again["__again"] == gone["__gone"], "left_anti"))
    away = gone.union(again).withColumnRenamed("__gone", "__away")
    once = docs.join(away, docs["doc_id"] == away["__away"], "left_anti")
    # combined before the shuffle: an id that many rows repeat costs one row per task
    least = (docs.join(again, docs["doc_id"] == again["__again"], "left_semi").groupBy(F.col("doc_id").alias("__id"))
             .agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("__row")))
    return once.union(least.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))
