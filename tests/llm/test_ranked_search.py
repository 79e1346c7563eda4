"""Ranked search against scoring every document."""

import math
import random
import re

import pytest

from stormcell.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(rows, items, top=50):
    docs = [(i, terms(t)) for i, t in rows if terms(t)]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        df = {t: sum(t in d for _, d in docs) for t in ts}
        found = []
        for i, d in docs:
            m = 100 - 50 + ((50 * len(d) * n_docs) // n_terms)
            score = 0
            for t in ts:
                tf = d.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort()
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(found[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def tight(monkeypatch):
    """Many shards and windows, so that thresholds cut."""
    monkeypatch.setattr(ranked_search, "SHARD_DOCUMENTS", 70)
    monkeypatch.setattr(ranked_search, "WINDOW_DOCUMENTS", 8)


def zipf_rows(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 80])))) for i in range(n)]


@pytest.mark.parametrize("top, short", [(1, 32), (7, 4), (50, 1), (50, 10**9)])
def test_shards_skip_nothing_that_counts(spark, tight, monkeypatch, top, short):
    """All lists long, all short, and mixed."""
    monkeypatch.setattr(ranked_search, "SHORT", short)
    rows, rng = zipf_rows(700, 1), random.Random(2)
    items = [(k, " ".join(f"w{int(rng.random() ** 3 * 300)}" for _ in range(rng.randint(1, 25)))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ranked_search.top_documents(docs, spark.createDataFrame(items, "item_id long, text string"), top)
    assert got(found) == brute(rows, items, top)


def test_windows_are_skipped(tight):
    """With a threshold from earlier documents most windows are not looked at."""
    rows = zipf_rows(2000, 4)
    number = {f"w{k}".encode(): k + 1 for k in range(300)}
    docs = [(i, ranked_search.terms_of(t.encode())) for i, t in rows]
    batch = ranked_search._shard([i for i, _ in docs], [len(d) for _, d in docs], [[number[w] for w in d] for _, d in docs])
    shard = ranked_search.Shard(batch.to_pylist()[0], {k: 400 - k for k in range(301)}, 2000, 50_000)
    looked = []
    whole = shard._window
    shard._window = lambda w, *a: (looked.append(w), whole(w, *a))
    best = ranked_search.Best(3)
    shard.search([number[b"w150"], number[b"w0"], number[b"w40"]], best)
    assert len(best.ids) == 3 and len(looked) < shard.windows // 2


def test_rows(docs, rows, spark):
    items = [(1, rows[5][1]), (2, "naïve CAFÉ x!"), (3, None), (4, "--"), (None, "one two"), (6, "la"), (6, "one"), (7, "nowhere")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, rank int")
    assert got(ranked_search.top_documents(docs, df)) == brute(rows, items)


def test_item_blocks(docs, rows, spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "TERMS_PER_BLOCK", 40)
    items = [(k, rows[k][1]) for k in range(0, 30, 3)]
    df = spark.createDataFrame(items, "item_id long, text string")
    assert got(ranked_search.top_documents(docs, df)) == brute(rows, items)


def test_odd_rows(odd, empty, spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, None)]
    assert got(ranked_search.top_documents(odd, items)) == brute(rows, [(1, "a b")])
    assert got(ranked_search.top_documents(empty, items)) == []
    assert got(ranked_search.top_documents(odd, items.where("false"))) == []


def test_long_norms_do_not_overflow():
    import numpy as np
    sizes = np.array([10**6, 3], np.int64)
    assert ranked_search.length_norms(sizes, 10**12, 10**14).tolist() == [50 + 50 * s * 10**12 // 10**14 for s in (10**6, 3)]
