"""Classifiers, rules, fingerprints, urls and mixing: brute force where exact, held-out accuracy where learned."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from stormcell.llm import fingerprints, mixing, quality_classifier, quality_rules, toxicity, url_filter

CLEAN = "the a of and river stone light walk open green house small under after window paper".split()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(25, 80))]
        toxic, good = i % 7 == 0, i % 5 != 1
        if toxic:
            for w in rng.sample(["idiot", "loser", "scum", "pathetic", "grumpf", "blarg"], 3):
                words.insert(rng.randrange(len(words)), w)
        t = " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", " |", "###"]) for w in words)
        rows.append((i, t, "x", "s", len(t)))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    rows += [(700, None, "x", "s", 0), (701, "", "x", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, truth, fold, mod):
    rows = {r["doc_id"]: r for r in scored.collect()}
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and {700, 701} <= rows.keys()
    assert all(r["held_out"] == (crc32(str(i).encode()) % mod == fold) for i, r in rows.items())
    held = [i for i in range(600) if rows[i]["held_out"]]
    return np.mean([rows[i]["predicted"] == truth(i) for i in held])


def test_toxicity(labelled):
    docs, labels = labelled
    scored = toxicity.toxicity_scores(docs, labels)
    assert accuracy(scored, lambda i: int(i % 7 == 0), 1, 3) > 0.97


def test_mined_words_follow_the_class_sizes(spark):
    """A word's rates decide, however many labels there are: few toxic ones beside many clean ones, or more words than 360."""
    def mined(toxic, clean, words, in_toxic, in_clean, copies=0):
        rng = random.Random(4)
        ids = [i for i in range(4 * (toxic + clean)) if crc32(str(i).encode()) % 3 != 1][:toxic + clean]
        texts = [[rng.choice(CLEAN) for _ in range(30)] for _ in ids]
        for w in words:
            for k in [*rng.sample(range(toxic), in_toxic), *rng.sample(range(toxic, toxic + clean), in_clean)]:
                texts[k].insert(rng.randrange(30), w)
        for k in range(copies):
            texts[k] = [f"own{j}" for j in range(60)] + [f"edit{k}"]
        rows = [(i, " ".join(t), int(k < toxic)) for k, (i, t) in enumerate(zip(ids, texts))]
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        return set().union(*toxicity.mine_lexicons(df, df.select("doc_id", "toxic")))
    letters = [a + b + c for a in "bcdfgklm" for b in "aeiou" for c in "prstvxz"]
    few = ["grumpf" + x for x in letters[:10]]
    assert mined(60, 1200, few, 6, 0) == set(few)      # under eight documents, a tenth of the toxic ones
    assert mined(60, 1200, few, 20, 2) == set(few)     # two ordinary uses; the rate ratio is about 200
    assert mined(400, 400, few, 200, 20) == set()      # a rate ratio of 10
    assert mined(60, 1200, [], 0, 0, copies=12) == set()  # near copies of one text are one document
    many = ["blarg" + x + y for x in letters[:50] for y in "abcdefghij"]
    assert mined(200, 600, many, 30, 0) == set(many)   # 500 words


def test_quality_classifier(labelled):
    docs, labels = labelled
    assert accuracy(quality_classifier.quality_scores(docs, labels), lambda i: int(i % 5 != 1), 0, 5) > 0.97


def test_classifiers_without_labels(labelled, empty):
    docs, labels = labelled
    none = labels.where("false")
    for f in (toxicity.toxicity_scores, quality_classifier.quality_scores):
        assert f(docs, none).count() == docs.count()
        assert f(empty, labels).count() == 0


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.1
    rates = [(0.01, 0.6), (0.01, 0.5), (0.02, 0.5), (0.3, 0.3)]
    votes = np.column_stack([rng.random(len(y)) < np.where(y, b, a) for a, b in rates])
    patterns = Counter((votes * (1 << np.arange(4))).sum(axis=1).tolist())
    posterior, rate, _, _ = toxicity.label_model(patterns, 4, 0.1)
    assert rate[1, 0] > 0.4 and rate[0, 0] < 0.05 and posterior[7] > 0.95 and posterior[0] < 0.1


def test_rule_statistics(docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.rule_statistics(docs).collect()}
    for i, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[j:j + 8]) for j in range(len(words) - 7)]
        n = Counter(windows)
        hit = {j + k for j, w in enumerate(windows) if n[w] > 1 for k in range(8)}
        assert tuple(got[i][1:6]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)), i


def test_rules_keep_clean(labelled, empty):
    docs, labels = labelled
    docs = docs.where("doc_id % 5 <> 1 OR doc_id % 15 = 1")  # anomalies are few
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    good = [i for i in range(600) if i % 5 != 1]
    assert np.mean([got[i]["kept"] for i in good]) > 0.97
    assert np.mean([got[i]["kept"] for i in range(600) if i % 15 == 1]) < 0.5
    assert got[700]["base_failed"] and not got[700]["kept"]
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.judge(docs, labels.where("false")).where("kept = base_failed").count() == 0


def test_each_row_is_kept_by_its_own_text(labelled, spark):
    docs, labels = labelled
    docs = docs.where("doc_id % 5 <> 1 OR doc_id % 15 = 1").select("doc_id", "text")
    good, bad = docs.where("doc_id = 5").first()["text"], "too short"
    more = spark.createDataFrame([(None, good), (None, bad), (5, bad), (900, bad), (900, good)], docs.schema)
    kept = Counter((r["doc_id"], r["text"]) for r in quality_rules.keep_good(docs.union(more), labels).collect())
    assert kept[None, good] == kept[900, good] == kept[5, good] == 1
    assert not kept[None, bad] and not kept[5, bad] and not kept[900, bad]
    judged = quality_rules.judge(docs.union(more), labels).where("kept")
    assert Counter(i for i, _ in kept.elements()) == Counter(r["doc_id"] for r in judged.collect())


def test_fingerprints(docs, rows, empty, odd, monkeypatch):
    monkeypatch.setattr(fingerprints, "BYTES_PER_RANGE", 4000)  # many ranges
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        made = t[:len(t) - half] + following[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(made.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(t.encode()).hex()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[3]["fingerprint"] == got[90]["fingerprint"] == got[91]["fingerprint"]
    bits = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    for i, r in got.items():
        want = sum((bits[i] ^ b).bit_count() <= 7 for b in bits.values()) if i % 50 == 0 else None
        assert r["n_within_radius"] == want
    assert fingerprints.fingerprints(empty).count() == 0
    assert fingerprints.fingerprints(odd).count() == 4


def test_near_copies_are_within_the_radius(spark, tmp_path):
    from stormcell.llm import catalog
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shingles = lambda w: {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
    texts, true = [text(300) for _ in range(400)], Counter()
    for q in range(0, 400, 50):
        for k in range(60):
            copy = list(texts[q])
            if k % 2:  # one block
                at = rng.randrange(250)
                copy[at:at + 36] = text(36)
            else:      # scattered words
                for j in rng.sample(range(300), 8):
                    copy[j] = rng.choice(words)
            a, b = shingles(texts[q]), shingles(copy)
            assert 0.75 <= len(a & b) / len(a | b) < 0.95
            texts.append(copy)
            true[q] += 1
    spark.createDataFrame([(i if i < 400 else i * 50 + 1, " ".join(t)) for i, t in enumerate(texts)],
                          "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in catalog.QUERIES["op7_fingerprints"](spark, str(tmp_path)).collect()}
    found = {q: got[q]["n_within_radius"] - 1 for q in true}
    assert all(found[q] <= true[q] for q in true)
    assert sum(found.values()) >= 0.95 * sum(true.values())
    bits = {i: int(r["fingerprint"], 16) for i, r in got.items()}
    assert all(found[q] == sum((bits[q] ^ b).bit_count() <= fingerprints.NEAR_RADIUS for b in bits.values()) - 1 for q in true)


def test_urls(spark):
    urls = ["http://a.example.org/en/2", "http://A.Example.ORG/es/1?x#y", "https://example.org/en/17", "http://x.com/fr/1",
            "http://x.com/de/1", "http://x.com/en", "http://org", "http://org/", "nothing", None, "", "ftp://h?q", "x://b.com#f",
            "http://notexample.org.net/es/", "http://example.org/es"] + [f"http://s{i}.example.org/en/{i}" for i in range(20, 60)] \
        + [f"http://s{i}.com/de/{i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            host = host.lower()
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit)[1:] if fit else (None, None)
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.where("false")).count() == 0
    assert url_filter.judge(pages.where("page_id in (8, 9)")).count() == 2


def brute_llr(train, text, order=4):
    """Log ratio per character by the recursion of the docstring."""
    counts = [defaultdict(lambda: [0, 0]) for _ in range(order + 1)]
    for s, a, b in train:
        p = "^" * order + s + "$"
        for i in range(order, len(p)):
            for k in range(order + 1):
                c = counts[k][p[i - k:i], p[i]]
                c[0] += a
                c[1] += b
    total = 0.0
    p = "^" * order + text + "$"
    for i in range(order, len(p)):
        value = []
        for cls in (0, 1):
            q = 1 / 256
            for k in range(order + 1):
                of = {ch: n[cls] for (ctx, ch), n in counts[k].items() if ctx == p[i - k:i] and n[cls]}
                n, types = sum(of.values()), len(of)
                if n:
                    q = (of.get(p[i], 0) + types * q) / (n + types)
            value.append(q)
        total += np.log(value[0] / value[1])
    return total / (len(p) - order)


def test_character_models(spark):
    train = [("abc.org/x", 3, 0), ("abd.org/y", 1, 1), ("zzz.com/de", 0, 4), ("zzy.com/de", 0, 1)]
    s = spark.createDataFrame([(x, a, b, True) for x, a, b in train] + [("abz.com/q", 0, 0, False)],
                              "shape string, allowed long, blocked long, train boolean")
    llr = {r["g"]: r["llr"] for r in url_filter.log_ratios(s).collect()}
    for text in ("abz.com/q", "abc.org/x"):
        p = "^^^^" + text + "$"
        got = np.mean([llr[p[i - 4:i + 1]] for i in range(4, len(p))])
        assert abs(got - brute_llr(train, text)) < 1e-9


def test_mixing(spark, docs, rows, empty):
    rng = random.Random(5)
    data = [(i, " ".join(["w"] * rng.randint(0, 40)), "big" if i < 700 else "small" if i < 900 else None, "e") for i in range(1000)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string, mix string")
    tokens = {i: len(t.split()) for i, t, *_ in data}
    total = Counter()
    for i, _, s, _ in data:
        total[s] += tokens[i]
    got = mixing.mix(table, repeat_limit=1.5).collect()
    seen = Counter(r["doc_id"] for r in got)
    assert set(seen) == {i for i, *_ in data}                      # every document once at least
    spent = Counter()
    for r in got:
        spent[r["source"]] += tokens[r["doc_id"]]
    ratio = {s: spent[s] / total[s] for s in total}
    assert abs(ratio["big"] - 1) < 1e-9 and 1.4 < max(ratio.values()) <= 1.5 + 1e-6
    assert len({(r["doc_id"], r["mix_epoch"]) for r in got}) == len(got)
    flat = mixing.exponent(spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "share double"), target_entropy=1.0, repeat_limit=None)
    w = np.array([0.7, 0.2, 0.1]) ** flat
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-3
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs).select(*docs.columns).columns == docs.columns


def test_mixing_with_clashing_names(spark, monkeypatch):
    """Columns named as the plan's and the output's; more sources than are broadcast."""
    data = [(i, "w " * (i % 9), f"s{i % 5}", i, 7) for i in range(300)]
    names = "doc_id long, text string, source string, epochs long, mix_epoch int"
    table = spark.createDataFrame(data, names).selectExpr("*", "1 AS blocks", "2 AS cut_block", "3 AS cut_place", "4 AS rest", "5 AS tokens", "6 AS key")
    got = mixing.mix(table)
    assert sorted(got.columns) == sorted([*table.columns, "mix_block", "mix_place"])
    want = sorted(map(tuple, got.select("doc_id", "epochs", "mix_epoch", "mix_block", "mix_place").collect()))
    assert {w[0] for w in want} == set(range(300))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(tuple, mixing.mix(table).select("doc_id", "epochs", "mix_epoch", "mix_block", "mix_place").collect())) == want


def test_plan_is_broadcast(spark):
    """Texts are not dealt by source."""
    table = spark.createDataFrame([(i, "w w", f"s{i % 5}") for i in range(100)], "doc_id long, text string, source string")
    plan = mixing.mix(table)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "BuildLeft" not in plan


def test_mixed_order(spark, tmp_path):
    table = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string")
    mixed = mixing.mix(table)
    mixing.in_order(mixed).write.parquet(f"{tmp_path}/out")
    import glob
    import pyarrow.parquet as pq
    seen = [tuple(r.values()) for f in sorted(glob.glob(f"{tmp_path}/out/part-*"))
            for r in pq.read_table(f, columns=["mix_epoch", "mix_block", "mix_place"]).to_pylist()]
    assert seen == sorted(seen) and len(seen) == mixed.count()


def test_mixing_counts_the_tokenizers_tokens(spark, docs, rows, tmp_path):
    import corpus_pipeline
    from stormcell.llm import catalog, token_counts
    path = catalog.tokenizer_path()
    own = {r["doc_id"]: r["t"] for r in docs.select("doc_id", mixing.bpe_tokens(spark, path).alias("t")).collect()}
    assert own == {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path).collect()}
    rng = random.Random(12)
    code = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000))
    data = [(i, code(), "encoded") for i in range(100)] \
        + [(i, " ".join(rng.choice(CLEAN) for _ in range(300)), "prose") for i in range(100, 200)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    mixed = [catalog.QUERIES["op6_temperature_mixing"](spark, str(tmp_path)), corpus_pipeline.source_mixing(spark, table, "")]
    for out in mixed:
        n = Counter(r["source"] for r in out.select("source").collect())
        assert n["encoded"] == 100 and n["prose"] > 120  # the encoded texts hold most tokens, in 100 words
