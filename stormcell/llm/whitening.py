"""Embedding whitening: the covariance's leading eigenvectors by a block Jacobi-Davidson method.

1. ``grid``: every remaining vector becomes integers ``floor(256 * c)``; ``fit_blocks`` keeps each distinct one once (copies are
   combined before the shuffle), packed into blocks of rows.  Counts and sums per dimension are exact.
2. The covariance is never formed.  ``Covariance`` multiplies it with a few vectors at once: tasks centre their rows first,
   then add up ``row * (row . v)``; one small array per task (or per group of tasks) reaches the driver.
3. ``jacobi_davidson`` keeps a search space with its products on the driver (vectors of one entry per dimension, at most
   ``SPACE`` of them).  Rayleigh-Ritz in that space gives the leading pairs; those that follow the locked ones and whose
   residual has reached double precision are locked, the others extend the space by the solution of the projected correction
   equation ``(I - QQ')(V - theta)(I - QQ') t = -r``, solved by MINRES for all of them side by side, so one distributed
   product serves one step of all.  Q holds the locked and the current Ritz vectors.  A full space is restarted from its best Ritz
   vectors.  It ends when all wanted pairs are locked.
4. ``whiten`` projects every remaining row and gives the covariance of the projected fit list, centred by its own mean.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, also those with another number of entries than
most rows have (ties: more entries).  Entries beyond 2**50 after scaling are taken as 2**50.  Components without variance
(eigenvalue below 1e-13 of the trace; the rest of a space of fewer than ``wanted`` dimensions) have no rows: one distinct
vector, or an empty table, gives none.  Repeated rows count once in the fit and are returned each.  A null vec_id stays null.
``deviation`` is null where it does not fit a long.  Equal eigenvalues: any orthonormal basis.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from .common import cut, map_batches, release, ship, to_batch

SCALE = 256
WANTED = 4
GUARDS = 4          # more Ritz pairs than wanted that the space is extended for
SPACE = 48          # most vectors in the search space
INNER = 14          # MINRES steps per correction
INNER_GAIN = 1e-3   # a correction is solved to this share of its residual
BLOCK_ROWS = 4096
TASK_BYTES = 8 << 20  # of packed vectors that a task of a product reads at least
DIRECT_PARTS = 64   # tasks whose sums are added up on the driver; more are combined in between
MOST = 1 << 50
EPS = float(np.finfo(float).eps)


def _grid(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors of the valid rows of a list column, and which rows these are."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False))
    at = np.flatnonzero(fits)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    values = np.asarray(pc.fill_null(flat, np.nan)).reshape(len(at), size)
    fine = np.isfinite(values).all(1)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * values[fine]), -MOST, MOST)
    return x.astype(np.int64), at[fine]


def _pack(x: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest integers that hold it, so equal vectors are equal bytes."""
    most = np.maximum(np.abs(x).max(1), np.abs(x + 1).max(1))
    return [v.astype("<i2" if m < 1 << 15 else "<i4" if m < 1 << 31 else "<i8").tobytes() for v, m in zip(x, most.tolist())]


def _unpack(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // size}").astype(np.int64)


def dimension(rows: DataFrame, vector: str) -> tuple[int, int]:
    """The number of entries that most vectors have, and how many vectors these are."""
    n = F.size(F.col(f"`{vector}`"))
    top = (rows.where(n > 0).groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("c"))
           .agg(F.max(F.struct("c", "n")).alias("top")).first()["top"])
    return (top["n"], top["c"]) if top else (0, 0)


def fit_blocks(rows: DataFrame, vector: str, size: int, tasks: int) -> DataFrame:
    """(n, data): the distinct integer vectors, up to ``BLOCK_ROWS`` in a row, in at most ``tasks`` partitions."""
    def vectors(b):
        x, _ = _grid(b.column(0), size)
        if len(x):
            yield to_batch("x binary", [_pack(x)])
    distinct = map_batches(rows.select(F.col(f"`{vector}`")), vectors, "x binary").distinct()

    def blocks(batches):
        held = []

        def block():
            x = np.stack([_unpack(v, size) for v in held])
            flat = _pack(x.reshape(1, -1))[0]
            return to_batch("n int, data binary", ([len(held)], [flat]))
        for b in batches:
            for v in b.column(0).to_pylist():
                held.append(v)
                if len(held) == BLOCK_ROWS:
                    yield block()
                    held = []
        if held:
            yield block()
    return distinct.coalesce(tasks).mapInArrow(blocks, "n int, data binary")


def _matrix(n: int, data: bytes, size: int) -> np.ndarray:
    return _unpack(data, n * size).reshape(n, size)


def sums(blocks: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum per dimension."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                s = _matrix(r["n"], r["data"], size).sum(0)
                yield to_batch("dim int, n long, s long", (np.arange(size), [r["n"]] * size, s))
    total = (blocks.mapInArrow(run, "dim int, n long, s long").groupBy("dim")
             .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    by = {r["dim"]: (r["n"], int(r["s"])) for r in total}
    return (by[0][0], [by[k][1] for k in range(size)]) if by else (0, [])


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``x - s / n`` with one rounding where the exact numerator fits a double."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, s)) < 1 << 62:
        return (n * x - np.array(s, np.int64)) / n
    return x - np.array([v / n for v in s])


class Covariance:
    """Products of the fit list's covariance (divisor n) with blocks of vectors, and its trace."""

    def __init__(self, blocks: DataFrame, size: int, n: int, s: list[int], tasks: int):
        self.blocks, self.size, self.n, self.s, self.tasks, self.products = blocks, size, n, s, tasks, 0
        ship(blocks.sparkSession)

    def _add_up(self, per_block, rows: int, columns: int) -> np.ndarray:
        """Mean over the fit list of what ``per_block`` adds up: one array per task, and where there are many tasks, one
        per group of tasks reaches the driver."""
        size, n, s = self.size, self.n, self.s

        def run(batches):
            total = None
            for b in batches:
                for r in b.to_pylist():
                    got = per_block(_centred(_matrix(r["n"], r["data"], size), n, s))
                    total = got if total is None else total + got
            if total is not None:
                yield to_batch("part binary", [[np.ascontiguousarray(total, float).tobytes()]])

        def add(batches):
            total = None
            for b in batches:
                for x in b.column(0).to_pylist():
                    total = np.frombuffer(x) if total is None else total + np.frombuffer(x)
            if total is not None:
                yield to_batch("part binary", [[total.tobytes()]])
        parts = self.blocks.mapInArrow(run, "part binary")
        if self.tasks > DIRECT_PARTS:
            parts = parts.repartition(int(np.ceil(np.sqrt(self.tasks)))).mapInArrow(add, "part binary")
        out = np.zeros((rows, columns))
        for r in parts.collect():
            out += np.frombuffer(r["part"]).reshape(rows, columns)
        return out / n

    def __call__(self, v: np.ndarray) -> np.ndarray:
        self.products += 1
        return self._add_up(lambda x: x.T @ (x @ v), self.size, v.shape[1])

    def trace(self) -> float:
        return float(self._add_up(lambda x: np.array([[np.einsum("ij,ij->", x, x)]]), 1, 1)[0, 0])

    def whitened_covariance(self, w: np.ndarray) -> np.ndarray:
        mean = self._add_up(lambda x: (x @ w).sum(0)[None, :], 1, w.shape[1])

        def spread(x):
            y = x @ w - mean
            return y.T @ y
        return self._add_up(spread, w.shape[1], w.shape[1])


def _against(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``t`` without its part in the span of ``q`` (orthonormal), twice for full precision."""
    for _ in range(2):
        t = t - q @ (q.T @ t)
    return t


def _new_directions(t: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span ``t`` outside the given spaces; columns with nothing new are left out."""
    out = np.empty((len(t), 0))
    for v in t.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            for q in (*spaces, out):
                v = v - q @ (q.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-8:
                break
            v = v / left
        else:
            out = np.c_[out, v]
    return out


def minres(product, r: np.ndarray, theta: np.ndarray, q: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """Solve ``P (V - theta_k) P t_k = -r_k`` for all columns side by side, ``P = I - QQ'``: Lanczos with Givens rotations.
    A column rests once its residual is below ``gain`` of ``r_k``; one product serves a step of all columns."""
    b = _against(-r, q)
    k = b.shape[1]
    beta = np.linalg.norm(b, axis=0)
    start, live = beta.copy(), beta > 0
    v, before = b / np.where(live, beta, 1), np.zeros_like(b)
    t, w, w_before = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    phi, delta_next, epsilon = beta.copy(), np.zeros(k), np.zeros(k)
    c, s, beta_k = -np.ones(k), np.zeros(k), np.zeros(k)
    for _ in range(steps):
        if not live.any():
            break
        on = np.flatnonzero(live)
        y = np.zeros_like(v)
        y[:, on] = product(v[:, on])
        y = _against(y - v * theta, q) - before * beta_k
        alpha = np.einsum("ij,ij->j", v, y)
        y = _against(y - v * alpha, q)
        beta_next = np.linalg.norm(y, axis=0)
        old_epsilon, delta = epsilon, c * delta_next + s * alpha
        gamma_bar = s * delta_next - c * alpha
        epsilon, delta_next = s * beta_next, -c * beta_next
        gamma = np.maximum(np.hypot(gamma_bar, beta_next), EPS)
        c, s = gamma_bar / gamma, beta_next / gamma
        tau, phi = c * phi, s * phi
        w_new = (v - old_epsilon * w_before - delta * w) / gamma
        w_before, w = w, w_new
        t = t + np.where(live, tau, 0) * w_new
        before, v, beta_k = v, y / np.where(beta_next > 0, beta_next, 1), beta_next
        live = live & (phi > gain * start) & (beta_next > EPS * start)
    return _against(t, q)


def jacobi_davidson(product, size: int, wanted: int = WANTED, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, residual norms) of the ``wanted`` largest eigenvalues of a symmetric positive operator."""
    wanted = min(wanted, size)
    rng = np.random.default_rng(seed)
    space = np.linalg.qr(rng.standard_normal((size, min(size, 2 * (wanted + GUARDS)))))[0]
    image = product(space)
    locked, values, residuals = np.empty((size, 0)), [], []
    stuck, last = 0, np.inf
    while True:
        h = space.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        scale = max([*values, theta[0] if len(theta) else 0.0, 0.0])
        goal = 4 * EPS * np.sqrt(size) * scale
        full = space.shape[1] + locked.shape[1] >= size
        while len(values) < wanted and len(theta):
            r = _against(image @ y[:, :1] - theta[0] * (space @ y[:, :1]), locked)
            norm = float(np.linalg.norm(r))
            # at the rounding of the products themselves nothing gets smaller any more
            if not (norm <= goal or full or (stuck >= 3 and norm <= 100 * goal)):
                break
            locked = np.c_[locked, space @ y[:, :1]]
            values.append(float(theta[0]))
            residuals.append(norm)
            space, image = space @ y[:, 1:], image @ y[:, 1:]  # what is left of the space, already in Ritz form
            theta, y = theta[1:], np.eye(len(theta) - 1)
            stuck, last = 0, np.inf
        if len(values) == wanted:
            return np.array(values), locked, np.array(residuals)
        few = min(wanted - len(values) + GUARDS, len(theta))
        u, ritz = space @ y[:, :few], theta[:few]
        r = _against(image @ y[:, :few] - u * ritz, locked)
        now = float(np.linalg.norm(r[:, 0]))
        stuck, last = (0, now) if now < last / 2 else (stuck + 1, last)
        t = minres(product, r, ritz, np.linalg.qr(np.c_[locked, u])[0], INNER, INNER_GAIN)
        if space.shape[1] + few > min(SPACE, size):  # restart from the best Ritz vectors
            keep = max(few, min(SPACE, size) // 2)
            space, image = space @ y[:, :keep], image @ y[:, :keep]
        new = _new_directions(t, locked, space)
        if not new.shape[1]:
            new = _new_directions(rng.standard_normal((size, few)), locked, space)
        if new.shape[1]:
            space, image = np.c_[space, new], np.c_[image, product(new)]


class Whitening:
    """What a fit found: sums, count, components by falling eigenvalue, their share and the identity's error."""

    def __init__(self, n, sums_, trace, values, vectors, residuals, error):
        self.n, self.sums, self.trace, self.values, self.vectors = n, sums_, trace, values, vectors
        self.residuals, self.error = residuals, error


def fit(rows: DataFrame, vector: str = "embedding", wanted: int = WANTED) -> Whitening | None:
    """Fit on the distinct vectors of all rows; None where there is no variance."""
    size, count = dimension(rows, vector)
    if not size:
        return None
    tasks = max(1, -(-2 * count * size // TASK_BYTES))
    blocks = cut(fit_blocks(rows, vector, size, tasks))
    release(rows.sparkSession)
    n, s = sums(blocks, size)
    if n < 2:
        return None
    blocks.persist(StorageLevel.MEMORY_AND_DISK)  # read once per product; the checkpoint has it if an executor is lost
    try:
        cov = Covariance(blocks, size, n, s, tasks)
        trace = cov.trace()
        values, vectors, residuals = jacobi_davidson(cov, size, wanted)
        some = values > 1e-13 * trace
        values, vectors, residuals = values[some], vectors[:, some], residuals[some]
        sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        vectors = vectors * sign
        error = float(np.abs(cov.whitened_covariance(vectors / np.sqrt(values)) - np.eye(len(values))).max(initial=0))
    finally:
        blocks.unpersist()
    return Whitening(n, s, trace, values, vectors, residuals, error)


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - s)**2, exact; None beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, s))
    if most * most * x.shape[1] < 1 << 63:
        d = n * x - np.array(s, np.int64)
        return np.einsum("ij,ij->i", d, d).tolist()
    out = [sum((n * v - t) ** 2 for v, t in zip(row, s)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


_ROWS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
         "residual double")


def whiten(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", wanted: int = WANTED) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual) of every remaining row and component."""
    found = fit(rows, vector, wanted)
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], _ROWS)
    n, s, size, k = found.n, found.sums, found.vectors.shape[0], len(found.values)
    axes = found.vectors / np.sqrt(found.values)
    share, residual, error = found.values / found.trace, found.residuals, found.error

    def run(b):
        x, at = _grid(b.column(1), size)
        if not len(x):
            return
        ids = b.column(0).take(pa.array(np.repeat(at, k)))
        yield to_batch(_ROWS, (ids, np.tile(np.arange(1, k + 1), len(x)), np.full(len(x) * k, n),
                               [d for d in deviations(x, n, s) for _ in range(k)], (_centred(x, n, s) @ axes).ravel(),
                               np.tile(share, len(x)), np.full(len(x) * k, error), np.tile(residual, len(x))))
    return map_batches(rows.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")), run, _ROWS)
