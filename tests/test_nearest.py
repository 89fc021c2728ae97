import numpy as np
import pytest

from chromaspark.functions.nearest import nearest
from chromaspark.operators.neighbours import knn_join


def frame(spark, x, w=None):
    rows = [(i, [float(v) for v in r], float(w[i]) if w is not None else 1.0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, w double")


def brute(q, t, k, exclude=False):
    out = {}
    for i, a in enumerate(q):
        d = np.round(((a - t) ** 2).sum(axis=1), 9)
        order = [j for j in np.lexsort((np.arange(len(t)), d)) if not (exclude and j == i)]
        out[i] = order[:k]
    return out


@pytest.mark.parametrize("cell_rows", [4096, 16])
@pytest.mark.parametrize("exclude", [False, True])
def test_equals_brute_force(spark, cell_rows, exclude):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(8, 0.5, (150, 3)), np.round(rng.normal(0, 2, (100, 3)))])
    df = frame(spark, x)
    rows = nearest(df, df, 4, exclude_self=exclude, cell_rows=cell_rows).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["d2"], r["tid"])):
        got.setdefault(r["qid"], []).append(r["tid"])
    assert got == brute(x, x, 4, exclude)


@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_ward_cost_nearest(spark, cell_rows):
    rng = np.random.default_rng(2)
    x, w = rng.normal(0, 1, (200, 2)), rng.integers(1, 9, 200).astype(float)
    df = frame(spark, x, w)
    got = {r["qid"]: r["tid"] for r in nearest(df, df, 1, exclude_self=True, ward=True, cell_rows=cell_rows).collect()}
    for i in range(len(x)):
        cost = ((x[i] - x) ** 2).sum(axis=1) * 2 * w[i] * w / (w[i] + w)
        cost[i] = np.inf
        assert got[i] == int(np.argmin(cost))


def test_join_over_a_hot_vector(spark):
    """A third of the train rows share one vector; ties go to the smaller key."""
    rows = [(i, 0.0 if i % 3 == 0 else float(i % 7), float(i % 2)) for i in range(300)]
    train = spark.createDataFrame(rows, "run_id bigint, a double, b double")
    asked = spark.createDataFrame([(1000 + i, 0.1 * i, None) for i in range(30)], "run_id bigint, a double, b double")
    got = {}
    for r in knn_join(asked, train, ["a", "b"], 5).orderBy("run_id", "rank").collect():
        got.setdefault(r["run_id"], []).append(r["neighbour"])
    t = np.array([[r[1], r[2]] for r in rows])
    s = t.std(axis=0)
    for i in range(30):
        d = np.round((((np.array([0.1 * i, 0.0]) - t) / s) ** 2).sum(axis=1), 9)
        assert got[1000 + i] == list(np.lexsort((np.arange(300), d))[:5])


def test_cut_with_most_rows_at_the_maximum():
    """A dimension whose largest value holds most of the rows is cut all the same."""
    from chromaspark.functions.nearest import _cut_tree

    rng = np.random.default_rng(5)
    x = rng.random((4000, 3)) * [10, 1, 1]
    x[: 2400, 0] = 10.0
    dims, cuts = _cut_tree(x, 6)
    node = np.zeros(len(x), dtype=int)
    for _ in range(6):
        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > cuts[node])
    assert np.bincount(node).max() < 400
