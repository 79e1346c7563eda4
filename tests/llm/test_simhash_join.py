"""SimHash near-dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash

from stormcell.llm import simhash_join


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """{row: least row reachable} for a list of (doc_id, fingerprint)."""
    n = len(fps)
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x
    for i in range(n):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                at[b] = a
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(fps[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [least[find(i)] for i in range(n)]


def test_rows(docs, rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps)))
    assert len({w[2] for w in want}) < len(want)
    assert sorted(tuple(r) for r in simhash_join.near_components(docs).collect()) == want


def test_long_text_in_pieces(rows):
    for _, t in rows:
        data = None if t is None else t.encode()
        assert simhash_join.simhash(data, piece=64) == simhash_join.simhash(data) == brute_fingerprint(t)


@pytest.mark.parametrize("few", [2, 5, 256])
def test_links_in_dense_families(spark, monkeypatch, few):
    """Families of fingerprints around common ones: compared in keys and by points around them, the same components."""
    monkeypatch.setattr(simhash_join, "KEY_MEMBERS", few)
    rng = random.Random(3)
    fps = set()
    for centre in [0, (1 << 64) - 1, rng.getrandbits(64), rng.getrandbits(64)]:
        for _ in range(120):
            x = centre
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    least = brute_components(list(enumerate(fps)))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    at = {int(np.uint64(f).astype(np.int64)): i for i, f in enumerate(fps)}
    part = list(range(len(fps)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for r in simhash_join.links(df).collect():
        a, b = sorted((find(at[r["a"]]), find(at[r["b"]])))
        part[b] = a
    assert [find(i) for i in range(len(fps))] == least


def test_odd_rows(odd, empty):
    got = sorted((tuple(r) for r in simhash_join.near_components(odd).collect()), key=str)
    f = f"{brute_fingerprint('a b c d e f g'):016x}"
    assert got == sorted([(1, f, 1), (1, f, 1), (None, f, 1), (2, "0" * 16, 2)], key=str)
    assert simhash_join.near_components(empty).collect() == []


def test_no_doc_id_at_all(spark):
    df = spark.createDataFrame([(None, "x y z"), (None, None)], "doc_id long, text string")
    assert {r["component_id"] for r in simhash_join.near_components(df).collect()} == {None}


def test_hot_copies(spark):
    """Copies that hold most rows are joined by broadcast."""
    rows = [(i, "the same text for all of them") for i in range(400)] + [(400 + i, f"w{i} x{i} y{i} z{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_join.near_components(df).collect()}
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    assert got == dict(zip([i for i, _ in rows], brute_components(fps)))
