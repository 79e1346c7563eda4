"""Quality classifier: naive Bayes support vectors.

Features are indicators of word and shape n-grams (hashed to 2**18).  Each is scaled by its log-count ratio between the
classes; a linear hinge-loss model over the scaled indicators is fitted by dual coordinate descent, and a logistic curve over
margins of rows kept out of the fit turns margins into scores.

The fit uses a bounded sample: at most ``linear.SAMPLE_PER_CLASS`` labelled rows of each class outside the held-out fold,
each with its whole text.  Every document is scored.  Null or blank text: no feature, the score of the intercept.
Labels other than 0 and 1 are ignored; without labels of both classes every score is the share of good labels (0.5 without any).
Repeated rows get equal scores.  No other column than doc_id and text is read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .linear import BITS, HashedNumbers, labelled_sample, packed_features, score_all, sigmoid

FOLD, MOD, THRESHOLD = 0, 5, 0.3
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 10
_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_NUMBER = HashedNumbers()


def _shape(w: str) -> str:
    if w.isalpha():
        return "A" if w.isupper() and len(w) > 1 else "Aa" if w[:1].isupper() else "a"
    return "0" if w.isdigit() else w[:3]


def ngrams(data: bytes | None) -> set[int]:
    """Numbers of a text's n-grams: words, shapes of 1 to 3 neighbours, and immediate repeats."""
    words = _PARTS.findall((data or b"").decode("utf-8", "replace"))
    number = _NUMBER
    out = {number[x] for x in {w.lower() for w in words}}
    shapes = [_shape(w) for w in words]
    out |= {number[x] for x in {f"1 {a}" for a in set(shapes)}}
    out |= {number[x] for x in {f"2 {a} {b}" for a, b in set(zip(shapes, shapes[1:]))}}
    out |= {number[x] for x in {f"3 {a} {b} {c}" for a, b, c in set(zip(shapes, shapes[1:], shapes[2:]))}}
    same = sum(map(str.__eq__, words, words[1:]))
    if same * 5 > len(words):
        out.add(number["many repeats"])
    return out


def log_count_ratio(rows: list) -> np.ndarray:
    """Smoothed log ratio of the classes' indicator counts, per feature."""
    counts = np.full((2, 1 << BITS), SMOOTHING)
    for _, y, idx in rows:
        counts[y, idx] += 1
    p = counts / counts.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def dual_descent(rows: list, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 5):
    """Weights and intercept of the hinge-loss model over ratio-scaled indicators of unit length."""
    w = np.zeros(1 << BITS)
    bias, alpha = 0.0, np.zeros(len(rows))
    x = []
    for _, y, idx in rows:
        v = ratio[idx]
        norm = np.sqrt((v * v).sum()) or 1.0
        x.append((idx, v / norm, 2 * y - 1))
    share = np.mean([y for _, y, _ in rows])
    limit = {1: cost * 0.5 / share, -1: cost * 0.5 / (1 - share)}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            idx, v, y = x[i]
            grad = y * (w[idx] @ v + bias) - 1
            new = min(max(alpha[i] - grad / 2.0, 0.0), limit[y])  # squared length: 1 of the row, 1 of the intercept
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[idx] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def fit_curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve with smoothed targets (Newton's method)."""
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum() + 1e-6 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return a, b


def train(rows: list):
    """(weights over n-grams, curve); rows: (doc_id, label, feature numbers)."""
    fit, rest = [r for k, r in enumerate(rows) if k % 5], [r for k, r in enumerate(rows) if not k % 5]
    ratio = log_count_ratio(fit)
    w, bias = dual_descent(fit, ratio)
    margin = lambda idx: (w[idx] @ ratio[idx]) / (np.sqrt((ratio[idx] ** 2).sum()) or 1.0) + bias
    z = np.array([margin(idx) for _, _, idx in rest])
    return w, ratio, bias, fit_curve(z, np.array([y for _, y, _ in rest]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = packed_features(docs, labelled_sample(labels, "quality", FOLD, MOD), ngrams)
    classes = [y for k, (_, y, _) in enumerate(rows) if k % 5]
    if len(set(classes)) < 2 or len(rows) < 10:
        level = float(np.mean([y for _, y, _ in rows])) if rows else 0.5
        return score_all(docs, ngrams, np.zeros(1 << BITS), lambda z: np.full(len(z), level), FOLD, MOD, THRESHOLD)
    w, ratio, bias, (a, b) = train(rows)
    # margins need two sums per text: of weight * ratio and of ratio squared; both go through one complex weight
    both = w * ratio + 1j * ratio ** 2
    return _score(docs, both, bias, a, b)


def _score(docs, both, bias, a, b):
    from pyspark.sql import functions as F

    from .common import map_batches, text_bytes, to_batch
    from .linear import held_out

    def run(batch):
        s = np.array([both[np.fromiter(f, np.int64, len(f))].sum() for f in map(ngrams, batch.column(1).to_pylist())], complex)
        z = s.real / np.sqrt(np.where(s.imag > 0, s.imag, 1.0)) + bias
        return to_batch("doc_id long, score double", (batch.column(0), sigmoid(a * z + b)))
    scored = map_batches(text_bytes(docs), run, "doc_id long, score double", text="text")
    return scored.select("doc_id", held_out(FOLD, MOD).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
