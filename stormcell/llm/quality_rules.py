"""Quality rules: rule statistics per document, judged by an isolation forest.

1. ``rule_statistics``: per document the base counts (words, their characters, symbols, repeated lines, words in repeated
   8-word windows) and the ratios made of them; one pass, no shuffle.
2. ``fit_forest``: ``TREES`` trees over ``SAMPLE`` rows each, taken from all documents by hash; every node splits a random
   statistic at a random point.  The sample (TREES * SAMPLE rows at most) is the method's own bound and reaches the driver.
3. The anomaly score of a row is 2 ** (-mean path length / expected path length), computed in tasks for every row.
4. ``calibrate``: a histogram of scores of all labelled rows (1,000 cells per label) gives the threshold that rejects most
   low-quality rows, where a good row wrongly rejected weighs ``GOOD_WEIGHT`` low-quality rows (as shares).
   Without labels of both kinds nothing is rejected by score.

Null or blank text: no words, so the base rule fails it.  Repeated rows are judged alike.  Rows without doc_id are judged too
but have no label.  Other columns are kept by ``keep_good`` and never read otherwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut, map_batches, ngram_hashes, ship, text_bytes, to_batch, word_hashes, words_of

TREES = 100
SAMPLE = 256
GOOD_WEIGHT = 20.0
MIN_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
CELLS = 1000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
RATIOS = ["symbol_share", "upper_share", "mark_share", "digit_share", "repeat_share", "line_repeat_share", "echo_share",
          "variety", "word_length"]
#: What the forest looks at; repeats are left to the base rules, digits to nobody (clean texts hold numbers).
FOREST = ["symbol_share", "upper_share", "mark_share", "echo_share", "variety", "word_length"]
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"doc_id long, {_BASE}, " + ", ".join(f"{r} double" for r in RATIOS)


def repeated_words(hw: np.ndarray, k: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``k`` words that the text holds twice or more."""
    h = ngram_hashes(hw, k)
    if len(h) < 2:
        return 0
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(hw) + 1, np.int32)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics_of(data: bytes | None) -> tuple:
    """Base counts and ratios of one text."""
    data = data or b""
    words = words_of(data)
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = int(byte[:128].sum() + byte[192:].sum())
    inside = chars - int(byte[list(SPACES)].sum())
    symbols = int(byte[list(SYMBOLS)].sum())
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    hw = word_hashes(words)
    n, one = len(words), max(1, len(words))
    repeat = repeated_words(hw)
    echo = int((hw[1:] == hw[:-1]).sum())
    return (n, inside, symbols, dup, repeat, symbols / max(1, inside), int(byte[65:91].sum()) / max(1, inside),
            int(byte[[33, 63]].sum()) / one, int(byte[48:58].sum()) / max(1, inside), repeat / one, dup / max(1, len(lines)),
            echo / one, np.log1p(len(np.unique(hw))) / np.log1p(one), inside / one)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, ratios) of every row."""
    def run(b):
        return to_batch(SCHEMA, [b.column(0), *map(list, zip(*map(statistics_of, b.column(1).to_pylist())))])
    return map_batches(text_bytes(docs), run, SCHEMA, text="text")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, rng) -> list[np.ndarray]:
    """One tree as arrays (feature, cut, left child, path length added at a leaf); the right child follows the left."""
    limit = int(np.ceil(np.log2(max(2, len(x)))))
    feature, cuts, left, add = [-1], [0.0], [0], [0.0]
    todo = [(0, x, 0)]
    while todo:
        node, rows, depth = todo.pop()
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        open_ = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(open_):
            add[node] = depth + _expected(len(rows))
            continue
        f = int(rng.choice(open_))
        c = float(rng.uniform(lo[f], hi[f]))
        feature[node], cuts[node], left[node] = f, c, len(feature)
        for part in (rows[rows[:, f] <= c], rows[rows[:, f] > c]):
            todo.append((len(feature), part, depth + 1))
            feature.append(-1)
            cuts.append(0.0)
            left.append(0)
            add.append(0.0)
            if not len(part):
                todo.pop()
                add[-1] = depth + 1.0
    return [np.array(feature), np.array(cuts), np.array(left), np.array(add)]


def path_score(x: np.ndarray, trees, size: int) -> np.ndarray:
    """Anomaly scores (0 to 1, high: few random splits isolate the row)."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, cuts, left, add in trees:
        node = np.zeros(len(x), np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] > cuts[node]
            node = np.where(inner, left[node] + right, node)
        total += add[node]
    return 2.0 ** (-total / len(trees) / max(1e-9, _expected(size)))


def fit_forest(stats: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> tuple[list, int]:
    """Trees over a hash sample of all rows that pass the base rules."""
    place, need = F.xxhash64("doc_id", F.lit(seed)), trees * sample
    rows = stats.where(~base_failed()).select("doc_id", *FOREST)
    total = rows.count()
    # every task sends its first ``need`` rows: cut by hash beforehand, so that they are few in all
    share = 2 * need / max(1, total)
    while share < 1:
        low = rows.where(place < F.lit(int((share - 0.5) * 2 ** 64)))
        if low.count() >= need:
            rows = low
            break
        share *= 2
    rows = rows.orderBy(place, *FOREST).limit(need).toPandas()
    rng = np.random.default_rng(seed)
    x = rng.permutation(rows[FOREST].to_numpy())
    if not len(x):
        return [], 1
    size = min(sample, len(x))
    picks = [x[k * sample:(k + 1) * sample] if len(x) == trees * sample else x[rng.choice(len(x), size, replace=False)]
             for k in range(trees)]
    return [grow_tree(p, rng) for p in picks], size


def anomaly_scores(stats: DataFrame, forest) -> DataFrame:
    """Statistics with their anomaly ``score``."""
    trees, size = forest
    schema = f"doc_id long, {_BASE}, score double"

    def run(b):
        x = np.column_stack([np.asarray(b.column(b.schema.get_field_index(r))) for r in FOREST])
        score = path_score(x, trees, size) if trees else np.zeros(len(x))
        return to_batch(schema, [*b.columns[:6], score])
    return map_batches(stats, run, schema)


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """Score from which rows are rejected."""
    known = scored.where(~base_failed()).join(labels.select(F.col("doc_id"), F.col("quality")).where("quality is not null"), "doc_id")
    cells = (known.groupBy(F.floor(F.col("score") * CELLS).cast("int").alias("cell"), "quality").count().collect())
    good, bad = np.zeros(CELLS + 2), np.zeros(CELLS + 2)
    for r in cells:
        (good if r["quality"] else bad)[r["cell"]] += r["count"]
    if not good.sum() or not bad.sum():
        return 2.0
    above = lambda a: np.cumsum(a[::-1])[::-1] / a.sum()  # noqa: E731  share of rows in this cell or higher
    gain = above(bad) - GOOD_WEIGHT * above(good)
    if gain.max() <= 0:
        return 2.0
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best.mean() / CELLS)


def _fitted(docs: DataFrame, labels: DataFrame):
    """(scores of every row, forest, limit)"""
    stats = cut(rule_statistics(docs))
    forest = fit_forest(stats)
    scored = anomaly_scores(stats, forest)
    return scored, forest, calibrate(scored, labels)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, score) of every row."""
    scored, _, limit = _fitted(docs, labels)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") < limit))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that pass, each judged by its own text: doc_id, shared or missing, decides nothing."""
    _, (trees, size), limit = _fitted(docs, labels)
    ship(docs.sparkSession)
    names = SCHEMA.replace(",", "").split()[::2]
    at = [names.index(f) - 1 for f in FOREST]
    words, repeats = names.index("n_words") - 1, names.index("n_repeat_words") - 1

    @pandas_udf("boolean")
    def passes(texts):
        import pandas as pd
        s = np.array([statistics_of(x) for x in texts], float).reshape(-1, len(names) - 1)
        good = (s[:, words] >= MIN_WORDS) & (100 * s[:, repeats] <= REPEAT_PERCENT * s[:, words])
        score = path_score(s[:, at], trees, size) if trees else np.zeros(len(s))
        return pd.Series(good & (score < limit))
    return docs.where(passes(F.col("text").cast("binary")))
