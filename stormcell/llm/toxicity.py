"""Toxicity by weak supervision.

1. Voters: lexicons, lexicons mined from a bounded labelled sample, and patterns.  A voter fires on a text or abstains;
   a text's votes are one 16-bit pattern.
2. ``label_model``: the histogram of patterns over all documents (at most 2**16 rows) is a mixture of two classes.
   Expectation-maximisation estimates each voter's firing rate in either class (its accuracy); the voters' correlations
   given the class, estimated from the same histogram, shrink the votes of voters that repeat each other.
   The class share, and the rates the estimate starts from, come from labels outside the held-out fold.
3. A linear classifier (logistic loss, soft-thresholded weights) is trained on the posterior labels of a bounded sample of
   documents outside the held-out fold, over hashed word indicators and the votes.
4. Every whole text is scored.

Labels are read outside the held-out fold only, for the mined lexicons, the class share and the starting rates.  Null or blank text: no vote, no word.
Without labels the mined voters never fire.  Repeated rows get equal scores.  No other column than doc_id and text is read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, cut, map_batches, mix, ngram_hashes, text_bytes, to_batch, word_hashes, words_of
from .linear import BITS, HashedNumbers, held_out, labelled_sample, packed_features, score_all, sigmoid

FOLD, MOD, THRESHOLD = 1, 3, 0.7
SAMPLE_DOCUMENTS = 20_000
MINED_VOTERS = 6
RATE_RATIO = 20   # of a mined word's rate in toxic documents to that in clean ones
COPY_KEYS = 4
CHANCE = 1e-3     # of a mined word to speak for toxic by chance, at most
FALSE_WORDS = 10  # words that may pass the bound by chance, at most, in expectation
# Seed lexicons: ordinary insults by kind.
LEXICONS = {
    "mind": "idiot idiots moron morons stupid dumb imbecile cretin dimwit fool fools halfwit",
    "worth": "loser losers worthless useless pathetic failure nobody",
    "disgust": "scum trash garbage filth filthy disgusting vile vermin parasite",
    "mockery": "clown clowns laughable buffoon joke puppet",
    "hostility": "hate despise kill murder",
    "other_languages": "dummkopf abschaum versager müll widerlich imbécile ordure minable débile basura idiota estúpido patético",
}
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<![a-z])[a-z]++[0134@$*]++[a-z]+")
_UNMASK = str.maketrans("0134@$", "oieaas")
_PATTERN_VOTERS = 3
_NUMBER = HashedNumbers()


class Voters:
    """Sets of words, each a voter, and three patterns; ``votes`` gives the pattern and the text's distinct words."""

    def __init__(self, mined: list[set[str]]):
        self.sets = [set(v.split()) for v in LEXICONS.values()] + [set(m) for m in mined]
        self.sets += [set()] * (len(LEXICONS) + MINED_VOTERS - len(self.sets))
        self.of: dict[str, int] = {}
        for k, words in enumerate(self.sets):
            for w in words:
                self.of[w] = self.of.get(w, 0) | 1 << k
        self.size = len(self.sets) + _PATTERN_VOTERS

    def votes(self, data: bytes | None) -> tuple[int, set[str]]:
        raw = (data or b"").decode("utf-8", "replace")
        text = raw.lower()
        parts = " ".join(set(text.split()))  # neither words nor masked words hold a space: distinct parts are enough
        distinct = set(_WORD.findall(parts))
        hit = distinct & self.of.keys()
        v = 0
        for w in hit:
            v |= self.of[w]
        base = len(self.sets)
        if any(w.translate(_UNMASK) in self.of for w in _MASKED.findall(parts)):
            v |= 1 << base
        words = _WORD.findall(text) if hit and not {"you", "your"}.isdisjoint(distinct) else []
        if any(w in self.of and not {"you", "your"}.isdisjoint(words[max(0, k - 3):k + 4]) for k, w in enumerate(words)):
            v |= 1 << base + 1
        if len(hit) >= 2:
            v |= 1 << base + 2
        return v, distinct


def _copy_keys(data: bytes | None) -> list[int]:
    """Numbers that near copies share: four pairs of least hashes over the text's 5-word runs."""
    hw = word_hashes(words_of((data or b"").lower()))
    runs = ngram_hashes(hw, min(5, len(hw))) if len(hw) else np.zeros(1, U64)
    least = [int(mix(runs ^ mix(np.array([k + 1], U64))).min()) for k in range(2 * COPY_KEYS)]
    return [hash((k, *least[2 * k:2 * k + 2])) & 0x7FFFFFFF for k in range(COPY_KEYS)]


def _without_copies(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """doc_ids of the bounded sample; of near copies with one label only the least, as their words are no new evidence."""
    seen, kept = set(), []
    for doc, y, keys in packed_features(docs, sample, _copy_keys):
        keys = {(y, k) for k in keys.tolist()}
        if seen.isdisjoint(keys):
            kept.append(doc)
        seen |= keys
    return np.array(sorted(set(kept)), np.int64)


def mine_lexicons(docs: DataFrame, labels: DataFrame) -> list[set[str]]:
    """Words of the labelled sample that speak for label 1, dealt over the mined voters by rank.

    A word in ``t`` of ``T`` toxic and ``c`` of ``C`` clean documents counts if its smoothed rates differ by ``RATE_RATIO``
    and chance does not explain it: with toxic share ``q = T / (T + C)``, ``t`` or more of ``n = t + c`` documents are toxic
    with a chance of at most ``exp(-n KL(t / n, q))`` (Chernoff), which must not be over ``CHANCE``, nor over ``FALSE_WORDS`` per distinct word.
    Both bounds follow the class sizes; near copies count as one document.  All such words are taken; the bounded sample bounds their number."""
    sample = labelled_sample(labels, "toxic", FOLD, MOD)
    picked = text_bytes(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    schema = "word string, label int, n long"
    kept = _without_copies(docs, sample)

    def count(b):
        from collections import Counter
        seen: Counter = Counter()
        b = b.filter(pa.array(np.isin(np.asarray(b.column(0), dtype=np.int64), kept)))
        for data, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            seen.update((w, y) for w in set(_WORD.findall((data or b"").decode("utf-8", "replace").lower())))
            seen["", y] += 1  # all documents
        if seen:
            yield to_batch(schema, ([k[0] for k in seen], [k[1] for k in seen], list(seen.values())))
    toxic, clean = (F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)) for y in (1, 0))
    words = cut(map_batches(picked, count, schema, text="text").groupBy("word").agg(toxic.alias("t"), clean.alias("c")))
    all_, distinct = words.where("word = ''").first(), words.count() - 1
    if not all_ or not all_["t"] or not all_["c"] or not distinct:
        return [set() for _ in range(MINED_VOTERS)]
    t, c, n, q = F.col("t"), F.col("c"), F.col("t") + F.col("c"), all_["t"] / (all_["t"] + all_["c"])
    bound = -math.log(min(CHANCE, FALSE_WORDS / distinct))
    ratio = ((t + 0.5) / (all_["t"] + 1)) / ((c + 0.5) / (all_["c"] + 1))
    surprise = t * F.log(t / (n * q)) + F.when(c > 0, c * F.log(c / (n * (1 - q)))).otherwise(0.0)
    found = (words.where((F.col("word") != "") & (t > 0) & (ratio > RATE_RATIO) & (surprise > bound))
             .select("word", ratio.alias("ratio")).collect())
    ranked = [r["word"] for r in sorted(found, key=lambda r: (-r["ratio"], r["word"]))]
    return [set(ranked[k::MINED_VOTERS]) for k in range(MINED_VOTERS)]


def label_model(histogram: dict[int, int], voters: int, prior: float, start=None, rounds: int = 200):
    """(posterior by pattern, firing rates by class, correlations, class share) from the counts of vote patterns.

    ``start``: firing rates (2 by voters) to begin with; without it, texts with any vote begin as likely toxic."""
    patterns = np.array(sorted(histogram), np.int64)
    n = np.array([histogram[p] for p in patterns.tolist()], float)
    votes = (patterns[:, None] >> np.arange(voters) & 1).astype(float)
    share = min(0.5, max(1e-4, prior))

    def posterior(rate, weight):
        fire = np.log(rate[1] / rate[0]) * weight
        rest = np.log((1 - rate[1]) / (1 - rate[0])) * weight
        return sigmoid(np.log(share / (1 - share)) + votes @ fire + (1 - votes) @ rest)
    post = np.where(votes.sum(axis=1) > 0, 0.9, 0.02) if start is None else posterior(start, np.ones(voters))
    weight = np.ones(voters)
    corr = np.zeros((voters, voters))
    for _ in range(rounds):
        rates = []
        for q in (1 - post, post):
            m = n * q
            rates.append((m @ votes + 0.1) / (m.sum() + 1.0))
        rate = np.clip(np.array(rates), 1e-6, 1 - 1e-6)
        centred = votes - (rate[0] + (post[:, None] > 0.5) * (rate[1] - rate[0]))
        cov = (centred * n[:, None]).T @ centred / n.sum()
        sd = np.sqrt(np.diag(cov)) + 1e-9
        corr = cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.clip(corr, 0, None).sum(axis=1))
        new = posterior(rate, weight)
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return dict(zip(patterns.tolist(), post.tolist())), rate, corr, share


def _starting_rates(docs: DataFrame, labels: DataFrame, voters: Voters):
    """Smoothed firing rates of the voters by label in the bounded labelled sample; None unless both labels occur."""
    sample = labelled_sample(labels, "toxic", FOLD, MOD)

    def bits(data):
        v = voters.votes(data)[0]
        return [k for k in range(voters.size) if v >> k & 1]
    counts, total = np.full((2, voters.size), 0.1), np.full(2, 1.0)
    for _, y, idx in packed_features(docs, sample, bits):
        counts[y, idx] += 1
        total[y] += 1
    return counts / total[:, None] if (total > 1).all() else None


def train(rows: list, size: int, epochs: int = 15, rate: float = 0.5, shrink: float = 2e-4, seed: int = 3):
    """Logistic weights over feature numbers, one step per block of rows (AdaGrad with soft thresholds).

    rows: (target probability, feature numbers)."""
    w, g2, b, b2 = np.zeros(size), np.full(size, 1e-3), 0.0, 1e-3
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            part = [rows[i] for i in order[lo:lo + 64]]
            idx = np.concatenate([x for _, x in part])
            n = np.array([len(x) for _, x in part])
            owner = np.repeat(np.arange(len(part)), n)
            z = np.bincount(owner, w[idx], len(part)) + b
            err = sigmoid(z) - np.array([p for p, _ in part])
            feature, at = np.unique(idx, return_inverse=True)
            grad = np.bincount(at, err[owner], len(feature)) / len(part)
            g2[feature] += grad ** 2
            step = rate / np.sqrt(g2[feature])
            new = w[feature] - step * grad
            w[feature] = np.sign(new) * np.maximum(np.abs(new) - step * shrink, 0)
            b2 += err.mean() ** 2
            b -= rate / np.sqrt(b2) * err.mean()
    return w, b


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    voters = Voters(mine_lexicons(docs, labels))
    size = (1 << BITS) + voters.size

    def vote(b):
        return to_batch("doc_id long, pattern int", (b.column(0), [voters.votes(d)[0] for d in b.column(1).to_pylist()]))
    patterns = map_batches(text_bytes(docs), vote, "doc_id long, pattern int", text="text")
    histogram = {r["pattern"]: r["count"] for r in patterns.groupBy("pattern").count().collect()}
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(FOLD, MOD))
    prior = known.agg(F.avg("toxic").alias("p")).first()["p"]
    posterior = {}
    if histogram:
        posterior, *_ = label_model(histogram, voters.size, 0.05 if prior is None else float(prior),
                                    _starting_rates(docs, labels, voters))

    def features(data):
        v, words = voters.votes(data)
        number = _NUMBER
        out = {number[w] for w in words}
        out |= {(1 << BITS) + k for k in range(voters.size) if v >> k & 1}
        return out

    ids = (docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out(FOLD, MOD))
           .distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(SAMPLE_DOCUMENTS).withColumn("label", F.lit(0)))
    rows = []
    for _, _, idx in packed_features(docs, ids, features):
        v = sum(1 << int(k) - (1 << BITS) for k in idx[idx >= 1 << BITS])
        rows.append((posterior.get(v, 0.0), idx))
    w, b = train(rows, size) if rows else (np.zeros(size), 0.0)
    return score_all(docs, features, w, lambda z: sigmoid(z + b), FOLD, MOD, THRESHOLD)
