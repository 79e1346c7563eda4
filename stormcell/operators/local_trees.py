"""Boosted regression trees inside one task, for fits whose rows are one partition.

A round of ``grow`` is Spark ML's own random forest of one tree (``RandomForestRegressor(numTrees=1, bootstrap=False)``) on the
rows of a partition: the same weighted split candidates, the same draws of rows and of columns by node, the same sums in the
order of the rows, and so the same tree.  Spark starts about ten jobs for such a tree; here all rounds are one task.  The
functions are pickled by value: the workers need numpy, not this package."""

from __future__ import annotations

import json
import sys
from typing import NamedTuple, Sequence

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of Spark ML's trees: bins of a column, rows that split candidates come from, MB of node statistics per pass
MAX_BINS = 32
SPLIT_ROWS = 10_000
GROUP_MB = 256
EPSILON = 2.0 ** -52
NO_GAIN = -sys.float_info.max
MOST_STEP = 4.0          # bound of a row's Newton step
LEAST_CURVE = 1e-6       # least curvature of a row


# ------------------------------------------------------------------ the JVM's numbers
def java_exp(x: np.ndarray) -> np.ndarray:
    """``StrictMath.exp`` bit for bit (fdlibm): equal gains of two columns are told apart by the last bit of their sums."""
    hi_bits = (x.view(np.int64) >> 32) & 0x7FFFFFFF
    sign = np.signbit(x)
    big, near = hi_bits > 0x3FD62E42, hi_bits < 0x3FF0A2B2
    with np.errstate(all="ignore"):
        k = np.where(near, np.where(sign, -1.0, 1.0), np.trunc(1.44269504088896338700 * x + np.where(sign, -0.5, 0.5)))
        k = np.where(big & np.isfinite(k), k, 0.0)
        hi, lo = x - k * 6.93147180369123816490e-01, k * 1.90821492927058770002e-10
        r = np.where(big, hi - lo, x)
        t = r * r
        c = r - t * (1.66666666666666019037e-01 + t * (-2.77777777770155933842e-03 + t * (6.61375632143793436117e-05 + t * (
            -1.65339022054652515390e-06 + t * 4.13813679705723846039e-08))))
        y = np.where(k == 0, 1.0 - ((r * c) / (c - 2.0) - r), 1.0 - ((lo - (r * c) / (2.0 - c)) - hi))
        e = k.astype(np.int64)
        y = np.where(e >= -1021, np.ldexp(y, np.maximum(e, -1021)), np.ldexp(y, e + 1000) * 9.33263618503218878990e-302)
        y = np.where(hi_bits < 0x3E300000, 1.0 + x, y)
        y = np.where(x > 7.09782712893383973096e+02, np.inf, np.where(x < -7.45133219101941108420e+02, 0.0, y))
    return np.where(np.isnan(x), x, y)


def _murmur(data: bytes, h: int) -> int:
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


class XorShift:
    """Spark's ``XORShiftRandom``."""

    def __init__(self, seed: int):
        data = (seed & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")
        low = _murmur(data, 0x3C074A61)
        self.state = _murmur(data, low) << 32 | low

    def _step(self) -> int:
        s = self.state
        s ^= s << 21 & 0xFFFFFFFFFFFFFFFF
        s ^= s >> 35
        self.state = s = s ^ (s << 4 & 0xFFFFFFFFFFFFFFFF)
        return s

    def integer(self) -> int:
        s = self._step() & 0xFFFFFFFF
        return s - (s >> 31 << 32)

    def double(self) -> float:
        return (((self._step() & 0x3FFFFFF) << 27) + (self._step() & 0x7FFFFFF)) * 2.0 ** -53


class JavaRandom:
    """``java.util.Random``: its longs."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & 0xFFFFFFFFFFFF

    def long(self) -> int:
        out = []
        for _ in range(2):
            self.state = (self.state * 0x5DEECE66D + 0xB) & 0xFFFFFFFFFFFF
            s = self.state >> 16
            out.append(s - (s >> 31 << 32))
        return (out[0] << 32) + out[1] & 0xFFFFFFFFFFFFFFFF


# ------------------------------------------------------------------ draws
def bagged(n: int, rate: float, seed: int) -> np.ndarray:
    """Which of the ``n`` rows of the first partition a tree sees."""
    if rate == 1.0:
        return np.ones(n, bool)
    draw = XorShift(seed + 1).double
    return np.fromiter((draw() < rate for _ in range(n)), bool, n)


def columns_per_node(strategy: str, n: int) -> int:
    strategy = str(strategy).lower()
    named = {"all": n, "auto": n, "sqrt": np.ceil(np.sqrt(n)), "log2": max(1, np.ceil(np.log(n) / np.log(2))), "onethird": np.ceil(n / 3.0)}
    if strategy in named:
        return int(named[strategy])
    if strategy.isdigit() and int(strategy) > 0:
        return min(int(strategy), n)
    if 0 < float(strategy) <= 1:
        return int(np.ceil(float(strategy) * n))
    raise ValueError(f"featureSubsetStrategy {strategy!r}")


def drawn_columns(n: int, k: int, seed: int) -> list[int]:
    """``k`` of the columns in the order of a reservoir."""
    out, rng = list(range(k)), XorShift(seed)
    for i in range(k, n):
        at = int(rng.double() * (i + 1))
        if at < k:
            out[at] = i
    return out


def split_rows(n: int, share: float, seed: int) -> np.ndarray:
    """Rows that split candidates come from: all of them up to ``SPLIT_ROWS`` rows, beyond that a draw of about as many."""
    if share >= 1:
        return np.arange(n)
    rng = XorShift(JavaRandom(XorShift(seed).integer()).long())
    if share > 0.4:
        return np.flatnonzero(np.fromiter((rng.double() <= share for _ in range(n)), bool, n))
    found, at, shrink = [], -1, np.log1p(-share)
    while at < n:
        at += 1 + int(np.log(max(rng.double(), 5e-11)) / shrink)
        found.append(at)
    return np.array(found[:-1], np.int64)


# ------------------------------------------------------------------ trees
class Columns(NamedTuple):
    """Train rows: their values, and for each column its distinct values, every row's place among them, and the order in
    which Spark adds up the weights of those that are not zero."""

    x: np.ndarray
    values: list
    places: list
    orders: list


def columns_of(x: np.ndarray) -> Columns:
    found = [np.unique(x[:, f] + 0.0, return_inverse=True) for f in range(x.shape[1])]  # -0.0 is 0.0
    return Columns(x, [v for v, _ in found], [p.reshape(-1) for _, p in found], [map_order(v[v != 0]) for v, _ in found])


def map_order(v: np.ndarray) -> np.ndarray:
    """Places of distinct numbers in the order of a Scala ``HashMap`` with them as keys: a trie of five bits a level, whose
    nodes give their own entries before those of the nodes below."""
    with np.errstate(all="ignore"):
        bits, single = v.view(np.int64), v.astype(np.float32)
        h = np.where(single == v, single.view(np.int32).astype(np.int64), (bits ^ (bits >> 32 & 0xFFFFFFFF)) & 0xFFFFFFFF) & 0xFFFFFFFF
        whole = (np.trunc(v) == v) & (np.abs(v) < 2.0 ** 63)
        long = np.where(whole, v, 0).astype(np.int64)
        h = np.where(whole, np.where(long == long.astype(np.int32), long, long ^ (long >> 32 & 0xFFFFFFFF)) & 0xFFFFFFFF, h)
    h = h + ~(h << 9) & 0xFFFFFFFF  # Scala's mix
    h ^= h >> 14
    h = h + (h << 4) & 0xFFFFFFFF
    h ^= h >> 10
    out = []

    def put(places, shift):
        if shift >= 35:
            return out.extend(places.tolist())
        part = h[places] >> shift & 31
        size = np.bincount(part, minlength=32)
        alone = places[size[part] == 1]
        out.extend(alone[np.argsort(h[alone] >> shift & 31)].tolist())
        for b in np.flatnonzero(size > 1):
            put(places[part == b], shift + 5)
    put(np.arange(len(v)), 0)
    return np.array(out, np.int64)


def candidates(c: Columns, weight: np.ndarray, seed: int) -> list[np.ndarray]:
    """Split candidates of every column: midpoints of neighbours, at most about ``MAX_BINS`` - 1, of equal weight between them."""
    n = len(weight)
    most = min(MAX_BINS, n) - 1
    share = min(1.0, max(MAX_BINS ** 2, SPLIT_ROWS) / n)
    rows = split_rows(n, share, seed)
    whole = share * float(np.cumsum(weight)[-1])
    picked = weight if share == 1 else weight[rows]
    out = []
    for values, places, order in zip(c.values, c.places, c.orders):
        p = places if share == 1 else places[rows]
        w, seen = np.bincount(p, picked, len(values)), np.bincount(p, minlength=len(values)) > 0
        some = seen & (values != 0)
        v, w, count = values[some], w[some], int(np.count_nonzero(values[p] != 0))
        part = float(np.cumsum(w[order] if share == 1 else w)[-1]) if len(w) else 0.0
        if whole - part > EPSILON * count * 100:  # the weight that is left is that of the zeros
            at = int(np.searchsorted(v, 0.0))
            v, w = np.insert(v, at, 0.0), np.insert(w, at, whole - part)
        if len(v) - 1 <= most:
            out.append((v[:-1] + v[1:]) / 2.0)
            continue
        total, stride, i, cuts = np.cumsum(w), whole / (most + 1), 0, []
        aim = stride
        while i < len(v) - 1:
            before = np.abs(total[i:-1] - aim) < np.abs(total[i + 1:] - aim)
            k = int(before.argmax())
            if not before[k]:
                break
            i += k
            cuts.append((v[i] + v[i + 1]) / 2.0)
            aim += stride
            i += 1
        out.append(np.array(cuts))
    return out


def _variance(n, s, q):
    with np.errstate(all="ignore"):
        return np.where(n == 0, 0.0, (q - (s * s) / n) / n)


class Grown:
    """A tree while it grows: node 0 is the root; ``stats`` are weight, sum, sum of squares, rows."""

    def __init__(self):
        self.stats, self.impurity, self.gain, self.cut, self.kids = [], [], [], [], []

    def add(self, stats, impurity: float) -> int:
        self.stats.append(stats)
        self.impurity.append(impurity)
        self.gain.append(0.0)
        self.cut.append(None)
        self.kids.append(None)
        return len(self.stats) - 1


def grow(c: Columns, y: np.ndarray, weight: np.ndarray, seed: int, depth: int, least: int, rate: float, strategy: str) -> list[dict]:
    """One regression tree as the nodes of Spark ML's saved models, in pre-order."""
    n, wide = c.x.shape
    cuts = candidates(c, weight, seed)
    splits = np.array([len(v) for v in cuts])
    bins = int(splits.max(initial=0)) + 1
    rows = np.flatnonzero(bagged(n, rate, seed))
    binned = np.stack([np.searchsorted(t, v)[p[rows]] for t, v, p in zip(cuts, c.values, c.places)], 1)
    w, yy = weight[rows], y[rows]
    wy = w * yy
    parts = [w, wy, wy * yy, np.ones(len(rows))]
    k, rng = columns_per_node(strategy, wide), JavaRandom(seed)
    tree, node = Grown(), np.zeros(len(rows), np.int64)
    tree.add((0.0, 0.0, 0.0, 0), 0.0)
    stack = [(0, 0)]
    while stack:
        group, subsets, used = [], [], 0
        while stack:  # as many nodes as the statistics of one pass may hold
            sub = list(range(wide)) if k == wide else drawn_columns(wide, k, rng.long())
            need = 3 * 8 * int((splits[sub] + 1).sum())
            if used and used + need > GROUP_MB << 20:
                break
            group.append(stack.pop())
            subsets.append(sub)
            used += need
        slot_of = np.full(len(tree.stats), -1)
        slot_of[[i for i, _ in group]] = np.arange(len(group))
        slot = slot_of[node]
        live = np.flatnonzero(slot >= 0)
        cell = ((slot[live, None] * wide + np.arange(wide)) * bins + binned[live]).reshape(-1)
        sums = [np.bincount(cell, np.repeat(v[live], wide), len(group) * wide * bins).reshape(len(group), wide, bins) for v in parts]
        sub = np.array(subsets)
        at = np.arange(len(group))[:, None]
        sums = [np.cumsum(s[at, sub], axis=2) for s in sums]
        left, right = [s[..., :-1] for s in sums], [s[..., -1:] - s[..., :-1] for s in sums]
        open_ = np.arange(bins - 1) < splits[sub][..., None]
        able = splits[sub] > 0
        if group[0] == (0, 0):  # the root's statistics: both sides of the first split
            if able[0].any():
                f = int(able[0].argmax())
                own = [float(a[0, f, 0] + b[0, f, 0]) for a, b in zip(left, right)]
                tree.stats[0] = (*own[:3], int(own[3]))
                tree.impurity[0] = float(_variance(*(np.float64(v) for v in own[:3])))
        impurity = np.array([tree.impurity[i] for i, _ in group])[:, None, None]
        with np.errstate(all="ignore"):
            both = left[0] + right[0]
            gain = impurity - left[0] / both * _variance(*left[:3]) - right[0] / both * _variance(*right[:3])
            gain = np.where((left[3] < least) | (right[3] < least) | (gain < 0), NO_GAIN, gain)
        gain = np.where(open_, gain, -np.inf).reshape(len(group), -1)
        best = gain.argmax(1) if gain.shape[1] else np.zeros(len(group), int)
        moved = np.full(len(group), -1)
        to_bin, to_left, to_right = (np.zeros(len(group), np.int64) for _ in range(3))
        for g, (i, level) in enumerate(group):
            if not able[g].any():
                of = live[slot[live] == g]
                own = [float(np.cumsum(v[of])[-1]) if len(of) else 0.0 for v in parts]
                tree.stats[i], tree.impurity[i] = (*own[:3], int(own[3])), -1.0
                continue
            f, s = divmod(int(best[g]), bins - 1)
            won = float(gain[g, best[g]])
            if won <= 0 or level == depth:
                if won == NO_GAIN:
                    tree.impurity[i] = -1.0
                continue
            feature = subsets[g][f]
            tree.gain[i], tree.cut[i], kids = won, (feature, float(cuts[feature][s])), []
            for side in (left, right):
                own = [float(v[g, f, s]) for v in side]
                kids.append(tree.add((*own[:3], int(own[3])), float(_variance(*(np.float64(v) for v in own[:3])))))
            tree.kids[i] = kids
            moved[g], to_bin[g], (to_left[g], to_right[g]) = feature, s, kids
            stack += [(kid, level + 1) for kid in kids if level + 1 < depth and not abs(tree.impurity[kid]) < EPSILON]
        at = slot[live]
        on, at = live[moved[at] >= 0], at[moved[at] >= 0]
        node[on] = np.where(binned[on, moved[at]] <= to_bin[at], to_left[at], to_right[at])
    return _nodes(tree)


def _nodes(t: Grown) -> list[dict]:
    """Pre-order, two leaves of one prediction under a node being one leaf, which says what they say."""
    means = [s / n if n else 0.0 for n, s, *_ in t.stats]

    def joined(i) -> bool:
        """Whether the node ends up as a leaf."""
        if t.kids[i] is not None:
            a, b = (joined(kid) for kid in t.kids[i])
            if a and b and means[t.kids[i][0]] == means[t.kids[i][1]]:
                means[i], t.kids[i] = means[t.kids[i][0]], None
        return t.kids[i] is None
    joined(0)
    out = []

    def put(i) -> int:
        at = len(out)
        one = {"id": at, "prediction": means[i], "impurity": t.impurity[i], "impurityStats": list(t.stats[i][:3]), "rawCount": t.stats[i][3],
               "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        out.append(one)
        if t.kids[i] is not None:
            feature, cut = t.cut[i]
            one |= {"gain": t.gain[i], "leftChild": put(t.kids[i][0]), "rightChild": put(t.kids[i][1]),
                    "split": {"featureIndex": feature, "leftCategoriesOrThreshold": [cut], "numCategories": -1}}
        return at
    put(0)
    return out


def predicted(nodes: Sequence[dict], x: np.ndarray) -> np.ndarray:
    """What a tree says of every row."""
    feature = np.array([d["split"]["featureIndex"] for d in nodes])
    cut = np.array([(d["split"]["leftCategoriesOrThreshold"] or [np.nan])[0] for d in nodes])
    kids = np.array([(d["leftChild"], d["rightChild"]) for d in nodes])
    at, on = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        on = on[feature[at[on]] >= 0]
        if not len(on):
            return np.array([d["prediction"] for d in nodes])[at]
        i = at[on]
        with np.errstate(invalid="ignore"):
            at[on] = np.where(x[on, feature[i]] <= cut[i], kids[i, 0], kids[i, 1])


# ------------------------------------------------------------------ boosting
def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """(rounds to keep, whether ``patience`` rounds without gain follow): the first point at which training would stop."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def boost(x: np.ndarray, label: np.ndarray, weight: np.ndarray, held: np.ndarray, margin: np.ndarray, done: int, losses: Sequence[float],
          rounds: int, patience: int | None, chunk: int, p: dict) -> tuple[list[str], list[float], np.ndarray]:
    """``rounds`` more trees after ``done`` ones, fewer if ``patience`` ends the fit after some chunks: (trees as JSON, validation
    losses, margin)."""
    fit = np.flatnonzero(~held)
    if not len(fit):
        raise ValueError("no rows to fit trees on")
    if not np.isfinite(x[fit]).all():
        raise ValueError("Vector values MUST NOT be NaN or Infinity")
    if not (np.isfinite(weight[fit]) & (weight[fit] >= 0)).all():
        raise ValueError("Weights MUST NOT be Negative, NaN or Infinity")
    columns, trees, losses, old = columns_of(x[fit]), [], list(losses), len(losses)
    judged, positive = np.flatnonzero(held), ~(label[held] <= 0.5)
    for k in range(rounds):
        if patience is not None and k % chunk == 0 and best_round(losses, patience)[1]:
            break
        chance = 1.0 / (1.0 + java_exp(-margin[fit]))
        curve = np.maximum(chance * (1 - chance), LEAST_CURVE)
        step = np.fmin(np.maximum((label[fit] - chance) / curve, -MOST_STEP), MOST_STEP)
        nodes = grow(columns, step, weight[fit] * curve, p["seed"] + done + k, p["maxDepth"], p.get("minInstancesPerNode", 1),
                     p["subsamplingRate"], p["featureSubsetStrategy"])
        margin = margin + float(p["stepSize"]) * predicted(nodes, x)
        m = margin[judged]
        each = np.log1p(java_exp(np.where(positive, -m, m)))
        losses.append(float(np.cumsum(each)[-1] / len(m)) if len(m) else float("inf"))
        trees.append(json.dumps(nodes))
    return trees, losses[old:], margin
