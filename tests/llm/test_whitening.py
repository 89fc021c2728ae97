"""Embedding whitening against a dense eigendecomposition."""

from __future__ import annotations

import numpy as np
import pytest

from chromaspark.llm import whitening

COLUMNS = "vec_id bigint, embedding array<float>, component string, v int, id string"


def plain(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deviations, eigenvalues (falling) and eigenvectors."""
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    y = len(x) * x - x.sum(axis=0)
    c = y / len(x)
    values, directions = np.linalg.eigh(c.T @ c / len(x))
    return (y.astype(object) ** 2).sum(axis=1), values[::-1], directions[:, ::-1]


def compare(got: list, ids: list, vectors: np.ndarray, most: int = 32) -> None:
    deviation, values, directions = plain(vectors)
    x = np.floor(64 * vectors.astype(np.float64))
    centred = x - x.mean(axis=0)
    k = min(most, int(np.sum(values > values[0] * 1e-12)))
    assert len(got) == k * len(ids)
    by_component = {}
    for r in got:
        by_component.setdefault(r["component"], []).append(r)
    assert sorted(by_component) == list(range(1, k + 1))
    for j in range(k):
        want = centred @ directions[:, j] / np.sqrt(values[j])
        rows = by_component[j + 1]
        have = np.array([r["whitened"] for r in rows])
        top = int(np.argmax(np.abs(want)))
        have *= np.sign(next(h for h, r in zip(have, rows) if r["vec_id"] == ids[top] and abs(abs(h) - abs(want[top])) < 1e-7)) * np.sign(want[top])
        pairs = [sorted(zip(i, x, d)) for i, x, d in (([r["vec_id"] for r in rows], have, [int(r["deviation"]) for r in rows]), (ids, want, deviation))]
        assert [(i, int(d)) for i, _, d in pairs[0]] == [(i, int(d)) for i, _, d in pairs[1]]
        assert np.allclose([x for _, x, _ in pairs[0]], [x for _, x, _ in pairs[1]], atol=1e-7)
        assert np.allclose([r["explained"] for r in rows], values[j] / values.sum(), rtol=1e-9)
        assert all(r["n"] == len(ids) and r["identity_error"] < 1e-7 for r in rows)


def test_equals_eigenvectors(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(500, 40)) * np.geomspace(8, 0.3, 40)).astype(np.float32)
    v[7] = 0
    v[8:11] = v[3]
    ids = [*range(498), 3, 12]
    rows = [(i, [float(e) for e in x], "c", 1, "i") for i, x in zip(ids, v)]
    odd = [(600, None, "c", 1, "i"), (601, [], "c", 1, "i"), (602, [float("nan")] * 40, "c", 1, "i"), (603, [None, *[1.0] * 39], "c", 1, "i"),
           (604, [float("inf"), *[1.0] * 39], "c", 1, "i")]
    short = rng.normal(size=(30, 3)).astype(np.float32)
    others = [(700 + i, [float(e) for e in x], "c", 1, "i") for i, x in enumerate(short)]
    df = spark.createDataFrame(rows + odd + others, COLUMNS).repartition(40)  # more factors than are merged at a time
    got = whitening.whiten(df).collect()
    compare([r for r in got if not r["vec_id"] or r["vec_id"] < 600], ids, v)
    compare([r for r in got if r["vec_id"] and r["vec_id"] >= 700], list(range(700, 730)), short)


def test_waves_are_equal(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(e) for e in rng.normal(size=2 + i % 3)], "c", 1, "i") for i in range(60)], COLUMNS)
    whole = sorted(map(tuple, whitening.whiten(df).collect()))
    monkeypatch.setattr(whitening, "WAVE_BYTES", 1)
    assert [r[:4] for r in sorted(map(tuple, whitening.whiten(df).collect()))] == [r[:4] for r in whole]


@pytest.mark.parametrize("rows, n", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 4, 0), ([[1.0, 0.0], [1.0, 4.0], [1.0, 9.0]], 3), ([[5.0], [6.0]], 2)])
def test_small_and_constant_tables(spark, rows, n):
    df = spark.createDataFrame([(None, v, "c", 1, "i") for v in rows], COLUMNS)
    got = whitening.whiten(df).collect()
    assert len(got) == n and all(r["component"] == 1 and abs(r["explained"] - 1) < 1e-12 for r in got)


def test_huge_entries(spark):
    df = spark.createDataFrame([(i, [x, 1.0 * i]) for i, x in enumerate([1e300, -1e300, 0.0, 5.0])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert {int(r["deviation"]) for r in got if r["vec_id"] == 0} and all(np.isfinite(r["whitened"]) for r in got)


@pytest.mark.parametrize("matrix", [
    np.eye(20), np.diag([3.0, 3, 3, 1, 0, 0]), np.diag(np.abs(np.arange(-10, 11.0)) + 0.5) + np.diag(np.ones(20), 1),
    np.random.default_rng(1).normal(size=(64, 64)), np.vander(np.linspace(1, 2, 8)), np.array([[2.0]]),
    np.linalg.qr(np.random.default_rng(2).normal(size=(40, 40)))[0] @ np.diag([5.0] * 10 + [1 + 1e-9 * i for i in range(10)] + [1e-8] * 20),
])
def test_solver(matrix):
    s, v = whitening.principal(matrix, 10**6)
    want = np.linalg.svd(matrix, compute_uv=False)
    assert len(s) == np.sum(want > 1e-12 * want[0])
    assert np.allclose(s, want[: len(s)], rtol=0, atol=1e-13 * want[0] * len(matrix))
    assert np.allclose(v.T @ v, np.eye(len(s)), atol=1e-11)
    assert np.abs(matrix.T @ (matrix @ v) - v * s**2).max() <= 1e-13 * want[0] ** 2 * len(matrix)
