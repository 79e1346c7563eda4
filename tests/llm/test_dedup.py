"""N-gram join and passage removal against brute force."""

import hashlib

from stormcell.llm import ngram_join, passages


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (o := len(sets[a] & sets[b])) and 100 * o >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def brute_passages(rows):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][j:j + 50]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j:j + 50])] < i:
                gone[j:j + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def as_dict(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_components(docs, rows):
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 10
    assert as_dict(ngram_join.jaccard_components(docs)) == want


def test_components_small_blocks(docs, rows, monkeypatch):
    """Blocks of three sets and one star round: salts and the full comparison give the same."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 1)
    assert as_dict(ngram_join.jaccard_components(docs)) == brute_components(rows)


def test_join_edges(empty, odd, docs):
    assert ngram_join.jaccard_components(empty).collect() == []
    got = sorted(map(tuple, ngram_join.jaccard_components(odd).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 0, 2), (None, 3, None)], key=str)
    kept = ngram_join.keep_representatives(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_trie_matches_sets():
    import numpy as np
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    sets = [(np.sort(np.r_[np.delete(base, rng.integers(0, 80, k)), rng.integers(0, 2**63, k, dtype=np.uint64)]), d)
            for d, k in enumerate([0, 1, 5, 9, 12, 20, 40] * 5)]
    trie = ngram_join.build_trie([(s, d, len(s), d) for s, d in sets])
    for s, d in sets:
        want = {e for t, e in sets if e != d
                and 175 * len(np.intersect1d(s, t)) >= 75 * (len(s) + len(t))}
        assert set(ngram_join.probe_trie(trie, s, d, len(s), d)) == want


def test_passages(docs, rows):
    want = brute_passages(rows)
    assert sum(n for _, n, _ in want.values()) > 500
    assert as_dict(passages.passage_digest(docs)) == want


def test_passages_hot_anchor(docs, rows, monkeypatch):
    """Anchors with more than two occurrences take the salted way."""
    monkeypatch.setattr(passages, "HOT_OCCURRENCES", 2)
    monkeypatch.setattr(passages, "SHARD_WORDS", 200)
    assert as_dict(passages.passage_digest(docs)) == brute_passages(rows)


def test_different_texts_of_one_id(spark):
    """What repeats in one text of an id does not cut another text of that id; repeated rows are cut alike."""
    passage = " ".join(f"p{k}" for k in range(60))
    clean = " ".join(f"c{k}" for k in range(100))
    rows = [(1, passage), (2, f"x {passage} y"), (2, clean), (2, clean), (2, f"x {passage} y"), (2, None), (3, clean), (None, clean)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, copy int")
    got = sorted(tuple(r)[:3] for r in passages.passage_digest(docs).where("doc_id is not null").collect())
    assert got == sorted([(1, 60, 0), (2, 62, 60), (2, 62, 60), (2, 100, 0), (2, 100, 0), (2, 0, 0), (3, 100, 100)])
    after = passages.without_passages(docs)
    assert after.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in after.where("doc_id is not null").collect()) == sorted(
        [(1, passage), (2, "x y"), (2, "x y"), (2, clean), (2, clean), (2, ""), (3, "")])


def test_cut_text(docs, empty, odd, rows):
    cut = {r["doc_id"]: r for r in passages.without_passages(docs).collect()}
    words = brute_passages(rows)
    for i, t in rows:
        kept = (cut[i]["text"] or "").encode().split()
        assert hashlib.sha256(b" ".join(kept)).hexdigest() == words[i][2]
        if not words[i][1]:
            assert cut[i]["text"] == t
    assert passages.without_passages(docs).columns == docs.columns
    assert passages.passage_digest(empty).count() == 0
    assert passages.passage_digest(odd).count() == 4


def test_one_row_of_a_repeated_id_stays(spark):
    from collections import Counter
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a")] * 5 + [(1, "other words of one id " * 3, "b"), (2, text + " x", "c"), (2, text + " x", "c"),
                                   (3, "alone", "d"), (4, None, "e"), (4, None, "e"), (None, text, "f"), (None, text, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = ngram_join.keep_representatives(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert Counter(r[0] for r in got) == {1: 1, 3: 1, 4: 1, None: 2} and set(got) <= set(rows)
    assert got[0] in rows and {r[0]: r for r in got if r[0] == 1} == {r[0]: tuple(r) for r in kept.collect() if r[0] == 1}
