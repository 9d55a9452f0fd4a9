"""Whitening against plain numpy on all rows."""

import math

import numpy as np
import pytest

from docgraph.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, label int, n long, y string, whitened string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 5, "y", "w") for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def compared(spark, vectors, dimension, components=16):
    """Result held against exact sums and numpy's eigenvectors; returns its rows."""
    good = [(i, v) for i, v in enumerate(vectors) if v is not None and len(v) == dimension and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in good}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[float(a - b / n) for a, b in zip(v, s, strict=True)] for v in fit])
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > values.sum() * wh.NOTHING).sum()))
    got = wh.whiten(frame(spark, vectors), components).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, c) for i in x for c in range(1, k + 1))
    white = np.full((len(vectors), k), np.nan)
    for r in got:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x[r["vec_id"]], s, strict=True))
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9
    plain = np.array([[float(a - b / n) for a, b in zip(x[i], s, strict=True)] for i in x]) @ axes[:, :k] / np.sqrt(values[:k])
    mine = white[list(x)]
    signs = np.sign((plain * mine).sum(axis=0))
    assert np.abs(plain * signs - mine).max() < 1e-6
    return got


@pytest.mark.parametrize("dimension", [3, 40])
def test_equals_numpy(spark, dimension):
    rng = np.random.default_rng(dimension)
    v = [*(rng.standard_normal((400, dimension)) * np.geomspace(3, 0.3, dimension))]
    v += [v[0]] * 50 + [None, [], [None] * dimension, [float("nan")] * dimension, [math.inf] * dimension, [1.0] * (dimension + 1), [1e300] * dimension]
    compared(spark, v[:-1], dimension)
    assert len({r["vec_id"] for r in wh.whiten(frame(spark, v)).collect()}) == 450


def test_fewer_components_than_dimensions(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (60, 5)).astype(float)
    v[:, 3] = v[:, 0] + v[:, 1]
    compared(spark, list(v), 5)


def test_no_variance_and_no_rows(spark):
    assert wh.whiten(frame(spark, [[0.5, 1.0]] * 4)).count() == 0
    assert wh.whiten(frame(spark, [None, []])).count() == 0
    assert wh.whiten(frame(spark, [[1.0]]).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_equal_eigenvalues_stay_together(spark):
    """Eight pairs of equal eigenvalues and a ninth pair across the last component."""
    matrix = np.diag([9.0, 9, 8, 8, 7, 7, 6, 6, 5, 5, 4, 4, 3, 3, 2, 1, 1, 1, 0, 0])
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((20, 20)))
    values, vectors = wh.leading(spark, q @ matrix @ q.T)
    assert np.allclose(values, np.diag(matrix)[:16]) and np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-12)
    assert np.allclose(q @ matrix @ q.T @ vectors, vectors * values, atol=1e-11)


def test_eigenvalues_that_lie_close(spark):
    """As of very many vectors without direction: all within a ten-thousandth."""
    q, _ = np.linalg.qr(np.random.default_rng(6).standard_normal((64, 64)))
    want = np.sort(1 + 1e-4 * np.random.default_rng(7).standard_normal(64))[::-1]
    matrix = (q * want) @ q.T
    values, vectors = wh.leading(spark, (matrix + matrix.T) / 2)
    assert np.allclose(values, want[:16], rtol=1e-13) and np.abs(np.abs((vectors * (q[:, :16])).sum(axis=0)) - 1).max() < 1e-8


def test_lone_large_eigenvalues_over_a_dense_bulk(spark):
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    want = np.sort(np.r_[4e5, 400, 133, np.linspace(50, 69, 61)])[::-1]
    matrix = (q * want) @ q.T
    values, vectors = wh.leading(spark, (matrix + matrix.T) / 2)
    assert np.allclose(values, want[:16], rtol=1e-10) and np.abs(np.abs((vectors * q[:, :16]).sum(axis=0)) - 1).max() < 1e-9


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(4)
    for d in (1, 2, 30, 150):
        a = rng.standard_normal((d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [0.0, *((values[1:] + values[:-1]) / 2)[:: max(1, d // 7)]]:
            assert wh.inertia(a, shift) == (values > shift).sum()
    swap = np.kron(np.eye(80), [[0.0, 1.0], [1.0, 0.0]])
    assert wh.inertia(swap, 0.0) == 80 and wh.inertia(np.zeros((3, 3)), 0.0) == 0


def test_wide_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((500, 300)) * np.r_[np.linspace(4, 2, 20), np.full(280, 0.2)]
    compared(spark, list(v), 300)


def test_large_numbers_stay_exact():
    n, y = 10**9, np.array([[3 * 10**6, -5], [10**4, 7]])
    total = np.array([7 * 10**14, -3 * 10**9], dtype=object)
    want = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, total, strict=True)) for r in y]
    assert wh.deviations(y, n, total) == [w if w < 2**63 else None for w in want]
