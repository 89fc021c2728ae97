"""Space tree, t-SNE and UMAP positions against sums over all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from chromaspark.analysis import embed, layout


@pytest.mark.parametrize("dims", [2, 3])
def test_tree_repulsion_is_near_the_sum_over_pairs(dims):
    rng = np.random.default_rng(dims)
    y = np.concatenate((rng.normal(size=(700, dims)), rng.normal(size=(300, dims)) * 0.01 + 5, np.zeros((40, dims))))
    gap = y[:, None] - y[None]
    q = 1 / (1 + (gap**2).sum(axis=2))
    z, force = layout.repulsion(layout.space_tree(y), y)
    exact = (q[..., None] ** 2 * gap).sum(axis=1)
    assert np.abs(z / q.sum(axis=1) - 1).max() < 0.03
    assert np.linalg.norm(force - exact) < 0.03 * np.linalg.norm(exact)


def test_tree_of_few_and_equal_points():
    for y in (np.zeros((1, 2)), np.ones((50, 2)), np.array([[0.0, 0.0], [1.0, 1.0]])):
        tree = layout.space_tree(y)
        z, _ = layout.repulsion(tree, y)
        gap = y[:, None] - y[None]
        assert np.allclose(z, (1 / (1 + (gap**2).sum(axis=2))).sum(axis=1), rtol=0.05)


def _blobs(spark, n):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(n // 4, 5)) + 6 * rng.normal(size=5) for _ in range(4)])
    df = spark.createDataFrame([(i, [float(v) for v in r], 1.0) for i, r in enumerate(x)], "id bigint, v array<double>, w double")
    return x, df


class Here:
    """Blocks of a dense matrix of weights, worked on without Spark."""

    def __init__(self, p):
        i, j = np.nonzero(p)
        blocks = [(i // layout.BLOCK == b, b) for b in range(-(-len(p) // layout.BLOCK))]
        self.blocks = {b: (i[m] - b * layout.BLOCK, j[m], p[i[m], j[m]]) for m, b in blocks}

    def each(self, payload, work):
        return {b: work(payload, b, *v) for b, v in self.blocks.items()}


def test_tsne_loss_is_that_of_the_exact_gradient(spark, monkeypatch):
    x, df = _blobs(spark, 500)
    edges = embed.tsne_graph(df, 20.0)
    p = np.zeros((len(x), len(x)))
    for r in edges.select("i", "j", "p").collect():
        p[r["i"], r["j"]] = r["p"]
    ids, start = layout.arrays(embed._start(df, 2, 1.0), 2)
    assert ids.tolist() == list(range(500))

    def loss(y):
        d2 = ((y[:, None] - y[None]) ** 2).sum(axis=2)
        q = 1 / (1 + d2)
        np.fill_diagonal(q, 0)
        return float((p * np.log1p(d2)).sum() + np.log(q.sum()) + (p[p > 0] * np.log(p[p > 0])).sum())

    got, _, _ = layout.tsne_positions(Here(p), start, 250, 12.0)
    packed = layout.Edges(edges, ids)
    few, first, last = layout.tsne_positions(packed, start, 4, 12.0)
    packed.close()
    same, first_here, last_here = layout.tsne_positions(Here(p), start, 4, 12.0)
    assert np.allclose(few, same, atol=1e-6) and abs(first - first_here) < 1e-9 and abs(last - last_here) < 1e-6
    monkeypatch.setattr(layout, "OPEN", 1e-9)  # every cell is opened: the sum over all pairs
    exact, _, _ = layout.tsne_positions(Here(p), start, 250, 12.0)
    assert loss(got) < 0.7 * loss(start) and abs(loss(got) / loss(exact) - 1) < 0.03


def test_edges_are_sampled_by_weight():
    w = np.array([1.0, 0.5, 0.1, 0.0])
    counts = sum(layout.sampled(w, 1.0, t) for t in range(200))
    assert counts.tolist() == [200, 100, 20, 0]


def test_umap_keeps_neighbours(spark):
    x, df = _blobs(spark, 400)
    edges = embed.umap_graph(df, 15)
    pos, first, last = embed.umap_layout(df, edges, 2, 60)
    y = np.array([[r["e1"], r["e2"]] for r in pos.orderBy("id").collect()])
    assert len(y) == len(x) and np.isfinite([first, last]).all()

    def near(a):
        d = ((a[:, None] - a[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        return d.argsort(axis=1)

    rank, k = near(x).argsort(axis=1), 10
    close = near(y)[:, :k]
    far = np.maximum(np.take_along_axis(rank, close, axis=1) - k + 1, 0).sum()
    trust = 1 - far * 2 / (len(x) * k * (2 * len(x) - 3 * k - 1))
    assert trust > 0.9
