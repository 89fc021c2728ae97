"""Nearest vectors in many dimensions: all pairs of groups, a vector travelling once per group."""

import numpy as np

from chromaspark.functions import nearest as mod


def table(spark, x, first=0):
    rows = [(first + i, [float(v) for v in r], 1.0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, w double")


def brute(x, z, k, own):
    d2 = np.round(((x[:, None, :] - z[None, :, :]) ** 2).sum(axis=2), mod.DIGITS)
    if own:
        np.fill_diagonal(d2, np.inf)
    order = np.argsort(d2, axis=1, kind="stable")[:, :k]
    return {(i, int(j)) for i in range(len(x)) for j in order[i] if np.isfinite(d2[i, j])}


def test_vectors_travel_once_per_group(spark, monkeypatch):
    """Before, each query was copied to every block of the train side."""
    def copied(*_):
        raise AssertionError("a copy of each query for each block")

    monkeypatch.setattr(mod, "_query_blocks", copied)
    monkeypatch.setattr(mod, "GROUP_BYTES", 64 * 8 * 64)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    x[40:44] = x[3]  # ties go to the smaller id
    t = table(spark, x)
    got = {(r["qid"], r["tid"]) for r in mod.nearest(t, t, 5, exclude_self=True).collect()}
    assert got == brute(x, x, 5, True)


def test_fewer_rows_than_asked_and_no_rows(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(7, 20)), rng.normal(size=(3, 20))
    got = {(r["qid"], r["tid"]) for r in mod.nearest(table(spark, x), table(spark, z), 5).collect()}
    assert got == brute(x, z, 5, False)
    assert mod.nearest(table(spark, x[:0]), table(spark, z), 5).count() == 0


def test_own_cell_is_met_first(spark, monkeypatch):
    """In few dimensions a query starts in its own cell; the closest cells are sorted only where that cell is too small."""
    rng = np.random.default_rng(3)
    z, x = rng.integers(0, 40, size=(3000, 3)).astype(float), rng.integers(-5, 45, size=(200, 3)).astype(float)
    got = {(r["qid"], r["tid"]) for r in mod.nearest(table(spark, x), table(spark, z), 5, cell_rows=64).collect()}
    assert got == brute(x, z, 5, False)
    got = {(r["qid"], r["tid"]) for r in mod.nearest(table(spark, x), table(spark, z), 90, cell_rows=64).collect()}
    assert got == brute(x, z, 90, False)
