"""Whitening against an eigensolver on the formed covariance."""

import math

import numpy as np
import pytest

from stormcell.llm import whitening


def brute(rows):
    """{(row number, component): values} by exact integers and numpy's eigensolver."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n))
    kept = [(i, [math.floor(256 * float(c)) + 0 for c in v]) for i, v in kept if len(v) == size]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[n * c - t for c, t in zip(x, s)] for x in fit], float) / n
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    out = []
    for i, x in kept:
        d = sum((n * c - t) ** 2 for c, t in zip(x, s))
        y = np.array([(n * c - t) / n for c, t in zip(x, s)])
        out += [(i, k + 1, n, d, float(y @ q[:, k] / math.sqrt(e[k])), e[k] / np.trace(a.T @ a / n)) for k in range(min(4, size))]
    return out


def compare(df, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted((tuple(r) for r in df.collect()), key=key), sorted(brute(rows), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a = np.array([r[4] for r in got if r[1] == k])
        b = np.array([r[4] for r in want if r[1] == k])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)
    assert max(r[6] for r in got) < 1e-9 and len({r[6] for r in got}) == 1


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, component int, x string")


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 12)) * np.linspace(1, 1.3, 12) + 3
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(7, rows[7][1])]       # copies count once in the fit
    rows += [(2000, None), (2001, []), (2002, [1.0] * 11), (2003, [float("nan")] + [0.0] * 11), (2004, [float("inf")] * 12),
             (2005, [None] + [0.0] * 11), (None, [0.5] * 12)]
    compare(whitening.whiten(table(spark, rows).repartition(5)), rows)


def test_many_tasks(spark, monkeypatch):
    """Sums of many tasks are combined before the driver adds them up."""
    monkeypatch.setattr(whitening, "TASK_BYTES", 64)
    monkeypatch.setattr(whitening, "DIRECT_PARTS", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((150, 6)))]
    compare(whitening.whiten(table(spark, rows, "double")), rows)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_few_dimensions(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((40, size)))]
    compare(whitening.whiten(table(spark, rows, "double")), rows)


def test_large_entries(spark):
    """Deviations beyond 64 bits are null, others exact."""
    rows = [(i, [float(2 ** 40 + i), float(i * i)]) for i in range(30)]
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in whitening.whiten(table(spark, rows, "double")).collect()}
    want = {(r[0], r[1]): r[3] if r[3] < 1 << 63 else None for r in brute(rows)}
    assert got == {k: want[k] for k in got} and len(got) >= 30
    rows = [(i, [2.0 ** 41 * i, 1.0 * i]) for i in range(30)]
    assert {r["deviation"] for r in whitening.whiten(table(spark, rows, "double")).collect()} == {
        d if d < 1 << 63 else None for d in (r[3] for r in brute(rows))}


def test_no_variance(spark):
    schema = "vec_id long, component int, n long, deviation long, whitened double"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        df = whitening.whiten(table(spark, rows))
        assert df.collect() == [] and df.schema.simpleString().startswith("struct<" + schema.replace(", ", ",").replace(" ", ":")
                                                                           .replace("long", "bigint"))


def test_rank_below_wanted(spark):
    """Three points span two dimensions: two components."""
    rows = [(i, v) for i, v in enumerate([[0.0, 0.0, 0.0, 1.0, 5.0], [1.0, 0.0, 0.0, 1.0, 5.0], [0.0, 2.0, 0.0, 1.0, 5.0]])]
    got = whitening.whiten(table(spark, rows)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(i, k) for i in range(3) for k in (1, 2)]
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("size, gap", [(64, 1.0), (64, 1e-4), (200, 0.1)])
def test_solver(size, gap):
    """Eigenvalues of clustered spectra to double precision, residuals too."""
    rng = np.random.default_rng(size)
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    e = np.r_[100 + gap * np.arange(6), np.linspace(1, 90, size - 6)]
    v = q * e @ q.T
    value, vector, residual = whitening.jacobi_davidson(lambda x: v @ x, size)
    assert np.allclose(value, sorted(e)[::-1][:4], rtol=1e-13)
    assert residual.max() < 1e-11 and np.abs(vector.T @ vector - np.eye(4)).max() < 1e-13


def test_equal_eigenvalues():
    v = np.diag([5.0, 5.0, 5.0, 5.0, 5.0, 2.0, 1.0, 1.0] + [0.5] * 30)
    value, vector, _ = whitening.jacobi_davidson(lambda x: v @ x, 38)
    assert np.allclose(value, 5) and np.abs(v @ vector - 5 * vector).max() < 1e-12


def test_minres_solves():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    v = a + a.T
    q = np.linalg.qr(rng.standard_normal((30, 3)))[0]
    p = np.eye(30) - q @ q.T
    r = p @ rng.standard_normal((30, 2))
    theta = np.array([0.3, -1.1])
    t = whitening.minres(lambda x: v @ x, r, theta, q, 200, 1e-12)
    for k in range(2):
        assert np.linalg.norm(p @ (v @ t[:, k] - theta[k] * t[:, k]) + r[:, k]) < 1e-8 * np.linalg.norm(r[:, k])
