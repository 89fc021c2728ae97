"""Tree growth and SVR fits that do the same sums with less work."""

from __future__ import annotations

import numpy as np

from chromaspark.models import grower, kernel, knn
from chromaspark.models.base import training_table
from chromaspark.operators import neighbours, split


def test_draws_of_many_rows_are_those_of_a_generator_each():
    rng = np.random.default_rng(1)
    odd = np.array([0, 1, 2, 2**32, 2**64 - 1], dtype=np.uint64)
    seeds = np.concatenate((odd, rng.integers(0, 2**63, 3000).astype(np.uint64)))
    mean = rng.uniform(32.5, 3000, len(seeds))
    assert np.array_equal(np.array(grower.first_doubles(seeds, 3)).T, [np.random.default_rng(int(s)).random(3) for s in seeds])
    assert np.array_equal(grower._poisson_many(mean, seeds), [np.random.default_rng(int(s)).poisson(m) for s, m in zip(seeds, mean)])


def test_splits_from_filled_bins_are_those_from_all_bins():
    rng = np.random.default_rng(2)
    sizes, slots = [6, 1, 9, 40], 25
    bins = np.array([rng.integers(0, s, 300) for s in sizes]).astype(np.uint16)
    slot = np.concatenate((np.arange(slots), rng.integers(-1, slots, 300 - slots)))
    w = rng.integers(0, 4, 300).astype(float)
    w[:slots] = 1
    stats = np.stack((w, w * rng.normal(size=300)), axis=1)
    path = rng.integers(0, 2**63, slots).astype(np.uint64)
    for some in (0, 2):
        a = grower.best_splits(grower.histogram(bins, sizes, slot, slots, stats), sizes, 1, some, path)
        b = grower.sparse_splits(bins, sizes, slot, slots, stats, 1, some, path)
        assert np.array_equal(a.real, b.real) and a.real.any()
        for name in ("feature", "cut", "gain", "left", "right"):
            assert np.array_equal(getattr(a, name)[a.real], getattr(b, name)[a.real]), name


def test_sums_over_sorted_targets():
    rng = np.random.default_rng(3)
    x, times = rng.integers(0, 4, (30, 2)).astype(float), rng.integers(1, 50, 30)
    y = np.round(rng.normal(5, 2, times.sum()), 2)
    held = kernel.SortedTargets.of(x, times, y)
    which = np.repeat([int(np.flatnonzero((held.x == v).all(axis=1))[0]) for v in x], times)
    for eps in (0.01, 0.1, 1.0):
        p = np.round(rng.normal(5, 2, len(held.x)), 2)
        r = p[which] - y
        over = np.abs(r) - eps
        t = np.clip((over + kernel.SMOOTH) / (2 * kernel.SMOOTH), 0.0, 1.0)
        want = np.where(over >= kernel.SMOOTH, over, np.where(over <= -kernel.SMOOTH, 0.0, (over + kernel.SMOOTH) ** 2 / (4 * kernel.SMOOTH)))
        loss, slope = held.loss_and_slope(p, eps)
        assert np.isclose(loss, want.sum(), rtol=1e-10)
        assert np.allclose(slope, np.bincount(which, weights=t * np.sign(r)), atol=1e-9)


def test_an_svr_of_few_targets_takes_no_job_a_step(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(float(i % 9), float(i % 4), float(i % 9 + rng.normal())) for i in range(800)], "a double, b double, y double")
    monkeypatch.setattr(kernel, "LOCAL_TARGETS", 0, raising=False)
    far = kernel.fit_svr(rows, ["a", "b"], {"C": 1.0}, n_features=16)
    monkeypatch.setattr(kernel, "LOCAL_TARGETS", 1000, raising=False)

    def sums(*a, **b):
        raise AssertionError("a job a step")

    monkeypatch.setattr(kernel, "row_sums", sums)
    here = kernel.fit_svr(rows, ["a", "b"], {"C": 1.0}, n_features=16)
    assert here.converged and np.isclose(here.history[-1], far.history[-1], rtol=1e-6)


def test_neighbour_search_takes_the_rows_of_all_folds_once(spark, ds, monkeypatch):
    rows = split.hash_folds(ds.df.where("Retention_Time_min IS NOT NULL"))
    table = training_table(rows, ds.features, "Retention_Time_min", "regression")
    want = []
    for f in range(3):
        index = neighbours.fit_knn(table.rows.where(f"fold <> {f}"), table.features, 4, "y")
        test = table.rows.where(f"fold = {f}").withColumnRenamed("y", "actual")
        for i, k in enumerate((2, 4)):
            index.k = k
            said = neighbours.knn_predict(index, test, False).selectExpr("sqrt(avg(power(actual - prediction, 2))) AS s").first()["s"]
            want.append((i, f, said))
    monkeypatch.setattr(knn, "fit_knn", None)
    got = knn.cv_scores(table, [{"n_neighbors": 2}, {"n_neighbors": 4}])
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
