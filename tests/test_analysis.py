import numpy as np
import pytest

from chromaspark.analysis import embed, pca as pca_mod, qsrr as qsrr_mod, ward


def table(spark, x):
    cols = [f"f{j}" for j in range(x.shape[1])]
    rows = [(i, *[float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "run_id bigint, " + ", ".join(f"{c} double" for c in cols)), cols


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (30, 3)), rng.normal(12, 1, (30, 3))])
    return (*table(spark, x), x)


def brute_ward(x):
    clusters = {i: (x[i], 1.0) for i in range(len(x))}
    heights = []
    while len(clusters) > 1:
        ids, best = list(clusters), None
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                (ca, na), (cb, nb) = clusters[a], clusters[b]
                d = np.sqrt(2 * na * nb / (na + nb) * ((ca - cb) ** 2).sum())
                if best is None or d < best[0]:
                    best = (d, a, b)
        d, a, b = best
        (ca, na), (cb, nb) = clusters.pop(a), clusters.pop(b)
        clusters[min(a, b)] = ((ca * na + cb * nb) / (na + nb), na + nb)
        heights.append((d, min(a, b), max(a, b)))
    return heights


@pytest.mark.parametrize("tail", [0, 256])
def test_ward_equals_greedy_tree(spark, blobs, tail):
    df, cols, x = blobs
    x = x[20:44] if tail else x[25:35]
    small, cols = table(spark, x)
    tree = ward.ward_tree(small, cols, tail=tail, cell_rows=8)
    rows = ward.numbered_merges(tree).orderBy("step").collect()
    want = brute_ward(x)
    assert [r["step"] for r in rows] == list(range(len(x) - 1))
    assert np.allclose([r["height"] for r in rows], [w[0] for w in want], atol=1e-6)
    assert [(r["left"], r["right"]) for r in rows] == [(w[1], w[2]) for w in want]
    assert rows[-1]["size"] == len(x)


def test_ward_labels_with_copies(spark, blobs):
    _, _, x = blobs
    df, cols = table(spark, np.vstack([x, np.repeat(x[:1], 20, axis=0)]))
    tree = ward.ward_tree(df, cols)
    got = {r["run_id"]: r["cluster"] for r in ward.ward_labels(tree, df, 2).collect()}
    assert len(got) == 80 and {got[i] for i in [*range(30), *range(60, 80)]} == {0} and {got[i] for i in range(30, 60)} == {1}


def test_pca_properties(spark, blobs):
    df, cols, x = blobs
    fit = pca_mod.pca(df, cols)
    s = np.array([[r["pc1"], r["pc2"], r["pc3"]] for r in fit.scores(df).orderBy("run_id").collect()])
    assert np.allclose(s.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(np.cov(s.T), np.diag(fit.variance), atol=1e-8)
    assert np.allclose(fit.loadings.T @ fit.loadings, np.eye(3))
    assert abs(sum(fit.ratio()) - 1) < 1e-9 and fit.ratio() == sorted(fit.ratio(), reverse=True)


def test_qsrr_counts_missing_targets(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i + 1 if i % 4 else None) for i in range(20)], "run_id int, x double, Retention_Time_min double")
    fit = qsrr_mod.qsrr(df, ["x"])
    assert fit.dropped == 5 and fit.n == 15 and abs(fit.model.coef[0] - 2) < 1e-9 and abs(fit.r2 - 1) < 1e-9
    assert fit.points(df).count() == 15


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], 1.0) for i, r in enumerate(x)], "id bigint, v array<double>, w double")


def test_graph_weights():
    rng = np.random.default_rng(0)
    d = np.sort(rng.uniform(0.5, 5, (20, 15)), axis=1)
    p = embed.perplexity_weights(d, 5.0)
    assert np.allclose(-(p * np.log(np.maximum(p, 1e-300))).sum(axis=1), np.log(5.0), atol=1e-6)
    w = embed.fuzzy_weights(d)
    assert np.allclose(w.sum(axis=1), np.log2(15), atol=1e-6)


def test_graphs_are_symmetric(spark, blobs):
    v = vectors(spark, blobs[2])
    for g in (embed.tsne_graph(v, 5.0), embed.umap_graph(v, 8)):
        e = {(r["i"], r["j"]): r["p"] for r in g.collect()}
        assert all(abs(e[(j, i)] - p) < 1e-12 for (i, j), p in e.items())
    t = embed.tsne_graph(v, 5.0).agg({"p": "sum"}).first()[0]
    assert abs(t - 1) < 1e-9


@pytest.mark.parametrize("kind", ["tsne", "umap"])
def test_layouts_keep_blobs_apart(spark, blobs, kind):
    df, cols, x = blobs
    lay = embed.tsne(df, cols, 2, perplexity=8.0, epochs=12) if kind == "tsne" else embed.umap(df, cols, 2, k=8, epochs=8)
    rows = lay.points(df).orderBy("run_id").collect()
    y = np.array([[r["e1"], r["e2"]] for r in rows])
    assert len(rows) == 60 and np.all(np.isfinite(y))
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    same = (np.argsort(d, axis=1)[:, :5] < 30) == (np.arange(60)[:, None] < 30)
    assert same.mean() > 0.9
    if kind == "tsne":
        assert lay.last_loss < lay.first_loss
