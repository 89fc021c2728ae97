import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaspark.models import catalog as cat, kernel, linear, mlp, tune
from chromaspark.models.base import packed_score, training_table
from chromaspark.operators.explain import feature_importance
from chromaspark.operators.moments import correlation, fit_scaler, grams


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 6, 200).astype(float)
    x = np.column_stack([a, 100 - a, rng.integers(0, 4, 200)])
    y = 2 + 0.5 * x[:, 0] - 1.5 * x[:, 2] + rng.normal(0, 0.2, 200)
    c = (x[:, 0] > 2).astype(int) + (x[:, 2] > 2).astype(int)
    rows = [(i, *map(float, x[i]), float(y[i]), int(c[i]), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "run_id bigint, p double, q double, r double, y double, c int, fold int")
    reg = training_table(df, ["p", "q", "r"], "y", "regression")
    clf = training_table(df, ["p", "q", "r"], "c", "classification", 3)
    return df, x, y, c, reg, clf


def test_minimum_norm_on_collinear_features(table):
    _, x, y, _, reg, _ = table
    g = linear.total(list(linear.fold_grams(reg).values()))
    m = linear.fit_linear("LR", g, {}, scaled=False)
    xc = x - x.mean(axis=0)
    want = np.linalg.pinv(xc, rcond=1e-10) @ (y - y.mean())
    assert np.allclose(m.coef, want, atol=1e-6)
    r = y - x @ m.coef - m.intercept
    assert np.allclose(x.T @ r, 0, atol=1e-5)


def test_ridge_gradient_and_lasso_conditions(table):
    _, x, y, _, reg, _ = table
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    m = cat.fit("Ridge", reg, {"alpha": 10.0})
    w = np.array(m.coef) * x.std(axis=0)
    assert np.allclose(z.T @ (y - y.mean() - z @ w), 10.0 * w, atol=1e-6)
    m = cat.fit("Lasso", reg, {"alpha": 0.1})
    w = np.array(m.coef) * x.std(axis=0)
    grad = z.T @ (y - y.mean() - z @ w) / len(y)
    assert np.all(np.abs(grad) <= 0.1 + 1e-6)
    assert np.allclose(grad[w != 0], 0.1 * np.sign(w[w != 0]), atol=1e-6)


def test_fold_scores_by_gram_subtraction(table):
    _, x, y, _, reg, _ = table
    scores = linear.cv_scores("Ridge", linear.fold_grams(reg), [{"alpha": 1.0}])
    for _, f, s in scores:
        tr, te = np.arange(200) % 3 != f, np.arange(200) % 3 == f
        mu, sd = x[tr].mean(axis=0), x[tr].std(axis=0)
        z = (x[tr] - mu) / sd
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[tr] - y[tr].mean()))
        e = y[te] - y[tr].mean() - ((x[te] - mu) / sd) @ w
        assert abs(s - np.sqrt(np.mean(e**2))) < 1e-8


def test_packed_score_equals_row_score(table):
    df, _, _, _, reg, _ = table
    m = cat.fit("LR", reg, {})
    packed = packed_score(m.predict(reg.packed), "regression")
    row = m.predict(df).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert abs(packed - row) < 1e-9


def test_logistic_gradient(table):
    _, x, _, c, _, clf = table
    m = cat.fit("LR", clf, {"C": 1.0})
    rows = m.predict(clf.rows).orderBy("run_id").select("probability", "prediction").collect()
    p = np.array([r["probability"] for r in rows])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.array(m.fitted.coefficientMatrix.toArray())
    grad = z.T @ (p - np.eye(3)[c]) + w.T
    assert np.max(np.abs(grad)) < 1e-2
    assert np.mean([r["prediction"] for r in rows] == c) > 0.8


@pytest.mark.parametrize("name", ["DT", "RFC", "GBC", "SVC", "MLPC", "KNN"])
def test_classifiers_learn(table, name):
    _, _, _, _, _, clf = table
    params = {"n_estimators": 5, "max_depth": 5, "n_neighbors": 3, "max_iter": 40}
    m = cat.fit(name, clf, params)
    rows = m.predict(clf.rows).select("y", "prediction", "probability").collect()
    assert np.mean([r["y"] == r["prediction"] for r in rows]) > 0.9
    assert all(len(r["probability"]) == 3 and abs(sum(r["probability"]) - 1) < 1e-6 for r in rows)


def test_tree_importance(spark, table):
    m = cat.fit("DT", table[4], {"max_depth": None})
    rows = feature_importance(spark, m).orderBy("rank").collect()
    assert abs(sum(r["importance"] for r in rows) - 1) < 1e-9
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert feature_importance(spark, cat.fit("LR", table[4], {})).count() == 0


def test_kernel_and_mlp_beat_linear_on_a_sine(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-3, 3, 300)
    rows = [(i, float(x[i]), float(np.sin(2 * x[i])), i % 3) for i in range(300)]
    t = training_table(spark.createDataFrame(rows, "run_id bigint, x double, y double, fold int"), ["x"], "y", "regression")
    flat = packed_score(cat.fit("LR", t, {}).predict(t.packed), "regression")
    s = cat.fit("SVR", t, {"C": 10})
    assert s.converged and not cat.fit("SVR", t, {"C": 10, "max_iter": 2}).converged
    assert s.history[-1] < s.history[0]
    assert packed_score(s.predict(t.packed), "regression") < 0.5 * flat
    m = cat.fit("MLP", t, {"max_iter": 100})
    assert m.history[-1] < m.history[0]
    assert packed_score(m.predict(t.packed), "regression") < 0.8 * flat


@pytest.mark.parametrize("hidden", [4, (4,), (4, 3), (3, 2, 3)])
@pytest.mark.parametrize("classify", [False, True])
def test_mlp_gradient_by_differences(classify, hidden):
    rng = np.random.default_rng(0)
    x, wt = rng.normal(size=(7, 3)), rng.uniform(1, 3, 7)
    y = rng.integers(0, 2, 7) if classify else rng.normal(size=7)
    out = 2 if classify else 1
    sizes = (3, *mlp.layers_of(hidden), out)
    w = rng.normal(size=sum(a * b + b for a, b in zip(sizes, sizes[1:])))
    full = mlp.loss_and_gradient(x, y, wt, w, 3, hidden, out, classify)
    assert len(full) == 1 + len(w)
    for j in range(len(w)):
        step = np.zeros(len(w))
        step[j] = 1e-6
        up = mlp.loss_and_gradient(x, y, wt, w + step, 3, hidden, out, classify)[0]
        down = mlp.loss_and_gradient(x, y, wt, w - step, 3, hidden, out, classify)[0]
        assert abs((up - down) / 2e-6 - full[1 + j]) < 1e-4


def test_mlp_of_two_layers(spark, table, tmp_path):
    reg, clf = table[4], table[5]
    flat = packed_score(cat.fit("LR", reg, {}).predict(reg.packed), "regression")
    m = cat.fit("MLP", reg, {"hidden_layer_sizes": (50, 20), "max_iter": 60})
    assert packed_score(m.predict(reg.packed), "regression") < 1.5 * flat
    c = cat.fit("MLPC", clf, {"hidden_layer_sizes": (20, 10), "max_iter": 60})
    assert packed_score(c.predict(clf.packed), "classification") > 0.9
    c.save(spark, str(tmp_path / "m"))
    back = cat.load_model(spark, str(tmp_path / "m"))
    assert back.hidden == (20, 10) and back.weights == c.weights


def test_mlp_with_one_hot_vector(spark):
    """A vector that is nearly all runs is in both parts of the split; a table of one run holds nothing out."""
    rows = [(i, 1.0, 2.0, 0) for i in range(500)] + [(500 + i, float(i), 3.0, 0) for i in range(3)]
    hot = training_table(spark.createDataFrame(rows, "run_id bigint, x double, y double, fold int"), ["x"], "y", "regression")
    m = cat.fit("MLP", hot, {"max_iter": 30})
    assert abs(m.predict(hot.packed.where("x = 1")).first()["prediction"] - 2.0) < 0.2
    one = training_table(spark.createDataFrame(rows[:1], "run_id bigint, x double, y double, fold int"), ["x"], "y", "regression")
    assert abs(cat.fit("MLP", one, {"max_iter": 5}).predict(one.packed).first()["prediction"] - 2.0) < 0.2


def test_fourier_map_approximates_rbf(spark, table):
    sc = fit_scaler(table[0], ["p", "q", "r"])
    fmap = kernel.fourier_map(sc, 4000)
    x = table[1][:2]
    z = (x - np.array(sc.mean)) / np.array(sc.std)
    want = np.exp(-fmap.gamma * ((z[0] - z[1]) ** 2).sum())
    h = fmap.numpy(x)
    assert abs(h[0] @ h[1] - want) < 0.06


def test_choice_and_grids():
    assert tune.choose([(0, 0, 1.0), (1, 0, 1.0)], True) == 0
    assert tune.choose([(0, 0, 0.1), (1, 0, 0.4)], False) == 1
    assert len(cat.expand(cat.DEFAULT_GRIDS[("regression", "RF")])) == 4
    assert len(tune.random_grid({"a": [1, 2, 3], "b": [1, 2]}, 4)) == 4


def test_training_runs(ds):
    r = tune.train_regression(ds, ["LR", "DT", "nope"], {("regression", "DT"): {"max_depth": [2, 3]}})
    assert set(r.models) == {"LR", "DT"} and r.best_name() in r.models
    c = tune.train_classification(ds, ["KNN"], {("classification", "KNN"): {"n_neighbors": [3, 5]}})
    assert c.metrics.first()["support"] == c.test.count()
    table = tune.results_table(r, c)
    assert table.count() == 3
    curve = tune.learning_curve("LR", r.test, ds.features, "Retention_Time_min", "regression", sizes=(0.5, 1.0))
    assert tune.learning_curve_means(curve).count() == 2


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 7.0, 5.0), (4.0, 1.0, 5.0)], "a double, b double, k double")
    got = {(r["x"], r["y"]): r["r"] for r in correlation(df, ["a", "b", "k"]).collect()}
    assert abs(got[("a", "b")] - np.corrcoef([1, 3, 4], [2, 7, 1])[0, 1]) < 1e-12
    assert got[("a", "k")] is None and got[("k", "k")] is None and abs(got[("a", "a")] - 1) < 1e-12


def test_gram_subtraction_is_exact(table):
    _, x, y, _, reg, _ = table
    parts = grams(reg.rows, ["p", "q", "r"], "y", by="fold")
    rest = linear.total(list(parts.values())).merge(parts[0], -1.0)
    keep = np.arange(200) % 3 != 0
    xc = x[keep] - x[keep].mean(axis=0)
    assert np.allclose(rest.xx, xc.T @ xc)


def test_descent_crosses_a_nearly_linear_stretch():
    from chromaspark.functions.descent import lbfgs

    def bowl(w):
        left, right = 1.0 - w, w - 2.0
        slope = -1.0 / (1.0 + np.exp(-left)) + 100.0 / (1.0 + np.exp(-right)) + 2e-6 * w
        return float((np.logaddexp(0, left) + 100.0 * np.logaddexp(0, right) + 1e-6 * w * w)[0]), slope

    w, history, converged = lbfgs(bowl, np.array([-20.0]), tol=1e-8)
    assert converged and abs(bowl(w)[1][0]) < 1e-2 and history[-1] < history[0] / 4
    _, _, cut = lbfgs(bowl, np.array([-20.0]), rounds=2)
    assert not cut
