"""Histogram trees against plain growth on the single rows."""

from __future__ import annotations

import numpy as np
import pytest

from chromaspark.models import catalog as cat, grower, trees
from chromaspark.models.base import packed_score, training_table


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(9)
    a, b, c = rng.integers(0, 6, 600), rng.normal(size=600).round(1), rng.integers(0, 3, 600)
    y = a * 0.7 - b + (c == 1) * 2 + rng.normal(0, 0.4, 600)
    k = (a > 2).astype(int) + (b > 0.3)
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), float(y[i]), int(k[i]), i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "run_id bigint, a double, b double, c double, y double, k int, fold int")
    x = np.stack((a, b, c)).astype(float)
    return x, y, k, training_table(df, ["a", "b", "c"], "y", "regression"), training_table(df, ["a", "b", "c"], "k", "classification", 3)


def plain_tree(x, y, depth):
    """Mean of the leaf of each row, by trying every cut."""
    out = np.full(len(y), y.mean())
    best = None
    if depth and len(y) > 1:
        for f in range(len(x)):
            v = np.unique(x[f])
            for cut in (v[:-1] + v[1:]) / 2:
                left = x[f] <= cut
                gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, left
    if best is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(x[:, side], y[side], depth - 1)
    return out


def predictions(model, table):
    return np.array([r["prediction"] for r in model.predict(table.rows).orderBy("run_id").collect()])


@pytest.mark.parametrize("far", [False, True])
def test_tree_and_boosting_equal_plain_growth(tables, monkeypatch, far):
    x, y, _, reg, _ = tables
    if far:
        monkeypatch.setattr(grower, "LOCAL_BYTES", 0)
    reg.binned = None
    assert np.allclose(predictions(cat.fit("DT", reg, {"max_depth": 4}), reg), plain_tree(x, y, 4))
    raw = np.full(len(y), y.mean())
    for _ in range(3):
        raw += 0.1 * plain_tree(x, y - raw, 2)
    assert np.allclose(predictions(cat.fit("GB", reg, {"n_estimators": 3, "max_depth": 2}), reg), raw)
    reg.binned = None


def test_far_equals_local(tables, monkeypatch):
    _, _, _, reg, clf = tables
    params = {"n_estimators": 4, "max_depth": 4}
    got = {}
    for bound in (grower.LOCAL_BYTES, 0):
        monkeypatch.setattr(grower, "LOCAL_BYTES", bound)
        reg.binned = clf.binned = None
        got[bound] = [predictions(cat.fit(n, t, params), t) for n, t in (("RF", reg), ("RFC", clf), ("GBC", clf))]
        got[bound].append(trees.cv_scores("RFC", clf, [params, {"n_estimators": 2, "max_depth": 2}]))
        got[bound].append(trees.cv_scores("GB", reg, [{"n_estimators": 2, "max_depth": 2}, {"n_estimators": 3, "max_depth": 2}]))
    reg.binned = clf.binned = None
    one, two = got.values()
    for a, b in zip(one[:3], two[:3]):
        assert np.allclose(a, b)
    for a, b in zip(one[3:], two[3:]):
        assert [s[:2] for s in a] == [s[:2] for s in b] and np.allclose([s[2] for s in a], [s[2] for s in b])


@pytest.mark.parametrize("name, grid", [
    ("RFC", [{"n_estimators": 3, "max_depth": 2}, {"n_estimators": 7, "max_depth": None}]),
    ("GBC", [{"n_estimators": 2, "max_depth": 2}, {"n_estimators": 4, "max_depth": 2}]), ("DT", [{"max_depth": 1}, {"max_depth": None}]),
])
def test_search_scores_are_those_of_single_fits(tables, name, grid):
    from chromaspark.models.tune import _part

    clf = tables[4]
    for i, f, score in trees.cv_scores(name, clf, grid):
        part = _part(clf, f"fold <> {f}")
        held = clf.packed.where(f"fold = {f}")
        if name == "RFC":  # the draws depend on the seed and the row, so a part draws the same
            assert abs(packed_score(cat.fit(name, part, grid[i]).predict(held), "classification") - score) < 0.05
        else:
            assert abs(packed_score(cat.fit(name, part, grid[i]).predict(held), "classification") - score) < 1e-9


def test_fifty_rounds_begin_a_hundred(tables):
    reg = tables[3]
    short, long = (cat.fit("GB", reg, {"n_estimators": n, "max_depth": 2}) for n in (5, 10))
    for (a, va, _), (b, vb, _) in zip(short.members, long.members):
        assert np.array_equal(a.feature, b.feature) and np.allclose(va, vb)


def test_bootstrap_has_the_law_of_single_draws():
    ids = np.arange(20_000, dtype=np.uint64) * np.uint64(977)
    for w in (1.0, 5.0, 40.0):
        n = grower.poisson(np.full(len(ids) // (10 if w > 32 else 1), w), ids[: len(ids) // (10 if w > 32 else 1)], 3)
        assert abs(n.mean() / w - 1) < 0.03 and abs(n.var() / w - 1) < 0.08
    assert abs((grower.poisson(np.ones(len(ids)), ids, 4) == 0).mean() - np.exp(-1)) < 0.01
    assert not np.array_equal(grower.poisson(np.ones(len(ids)), ids, 4), grower.poisson(np.ones(len(ids)), ids, 5))


def test_saved_trees_predict_the_same(spark, tables, tmp_path):
    clf = tables[4]
    for name in ("RFC", "GBC"):
        m = cat.fit(name, clf, {"n_estimators": 3, "max_depth": 3})
        m.save(spark, f"{tmp_path}/{name}")
        again = cat.load_model(spark, f"{tmp_path}/{name}")
        assert np.array_equal(predictions(m, clf), predictions(again, clf)) and again.importances() == m.importances()
        assert abs(sum(m.importances()) - 1) < 1e-9


def test_fold_fits_are_those_of_parts(tables):
    from chromaspark.models.tune import _part

    for name, table in (("DT", tables[3]), ("GBC", tables[4])):
        params = {"n_estimators": 2, "max_depth": 3}
        for f, m in enumerate(trees.fold_fits(name, table, params)):
            assert np.allclose(predictions(m, table), predictions(cat.fit(name, _part(table, f"fold <> {f}"), params), table))
