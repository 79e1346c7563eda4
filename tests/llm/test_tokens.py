"""Packing and token counts: exact round trips."""

from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from stormcell.llm import packing, token_counts
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def plain():
    """The file's tokenizer as it is: a special token's string is that token."""
    return Tokenizer.from_file(PATH)


def test_packing_round_trip(spark, docs, rows, plain):
    more = [(9000, "a <|endoftext|> b"), (9001, "<|endoftext|>"), (9002, "日本 語 <|endoftext|>x")]
    rows, tokenizer = rows + more, plain
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = packing.pack(docs, PATH, keep_ids=True).cache()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got.collect():
        assert 1 <= r["length"] <= 2048 and crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in parts) == np.array(ids, "<u4").tobytes()
        assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts[:-1]]).tolist()
        assert all(r["length"] == 2048 for r in parts[1:])
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for x in by_doc.values() for r in x)
    assert len(by_sequence) <= -(-total // 2048) + 2
    made = packing.sequences(got).collect()
    assert sum(r["n_tokens"] for r in made) == total and all(len(r["ids"]) == 4 * r["n_tokens"] for r in made)


def test_best_two_fit_uses_all_pieces():
    rng = np.random.default_rng(2)
    histogram = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 2049), 300, replace=False), rng.integers(1, 50, 300))}
    used = defaultdict(int)
    for times, layout in packing.best_two_fit(histogram):
        assert times > 0 and sum(x * n for x, n in layout) <= 2048
        for x, n in layout:
            used[x] += times * n
    assert dict(used) == histogram
    # 1200 + 600 leaves 248; the 600 gives way to 500 + 348
    plan = packing.best_two_fit({1200: 1, 600: 1, 500: 1, 348: 1})
    assert plan[0] == (1, [(1200, 1), (500, 1), (348, 1)])


def test_encoder_equals_tokenizer(plain, rows):
    e, tokenizer = packing.Encoder(PATH), plain
    assert e.ranked is not None
    texts = [t for _, t in rows if t] + ["a  b", " x", "tail ", "x \n y", "don't we've", "a_b 1²½ x٣y", "日本 語", "\x1c a\x1d b",
                                         "<|endoftext|> hi", "tab\t b\r\n c", "a\n b", "e\u0301 x"]
    for t in texts:
        assert e(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:60]


def test_empty_and_repeated(empty, odd):
    assert packing.pack(empty, PATH).count() == 0
    got = packing.pack(odd, PATH).collect()
    assert len(got) == 4 and len({(r["sequence_id"], r["offset"]) for r in got}) == 4
    assert token_counts.count_tokens(empty, PATH).count() == 0


def test_edits_equal_counting_anew(spark, docs, rows, tokenizer):
    import random
    rng = random.Random(8)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    edits, want = [], {}
    bits = ["", " ", "  ", "\n", "x", " word", "don't", "123", "é", "a b c d", "!!", "\n\n  "]
    for i, t in rows:
        text = t or ""
        for seq in range(4):
            a = rng.randrange(len(text) + 1)
            z = min(len(text), a + rng.choice([0, 0, 1, 3, 30]))
            new = rng.choice(bits)
            edits.append((i, seq, a, z, new))
            text = text[:a] + new + text[z:]
            want[i, seq] = count(text)
    table = spark.createDataFrame(edits, "doc_id long, seq long, start long, stop long, replacement string")
    got = token_counts.apply_edits(docs, table, PATH).collect()
    assert {(r["doc_id"], r["seq"]): r["n_tokens"] for r in got} == want
    assert all(r["encoded"] < 60 for r in got if r["doc_id"] == rows[-1][0])  # 9,000 words, few encoded again
    whole = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, PATH).collect()}
    assert whole == {i: count(t or "") for i, t in rows}


def test_query_edits(docs, rows, tokenizer):
    got = {r["doc_id"]: r for r in token_counts.edited_counts(docs, PATH, token_counts.middle_edits).collect()}
    for i, t in rows:
        text = t or ""
        for a, z, new in token_counts.middle_edits(text):
            a, z = min(a, len(text)), min(z, len(text))
            text = text[:a] + new + text[max(a, z):]
        assert got[i]["n_tokens"] == len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert got[i]["n_tokens_after"] == len(tokenizer.encode(text, add_special_tokens=False).ids)
