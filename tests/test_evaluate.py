import numpy as np
import pytest

from chromaspark.functions import running
from chromaspark.operators import evaluate as ev


@pytest.fixture(scope="module")
def scores(spark):
    s = [0.9, 0.8, 0.8, 0.7, 0.4, 0.4, 0.4, 0.1]
    y = [True, True, False, True, False, True, False, False]
    return spark.createDataFrame([(1, a, b) for a, b in zip(s, y)], "class int, score double, positive boolean")


def test_roc_auc_pr(scores):
    pts = sorted((r["fpr"], r["tpr"]) for r in ev.roc_points(scores).collect())
    assert pts == [(0.0, 0.0), (0.0, 0.25), (0.25, 0.5), (0.25, 0.75), (0.75, 1.0), (1.0, 1.0)]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert abs(ev.auc(scores).first()["auc"] - area) < 1e-12
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in ev.pr_points(scores).collect()}
    assert pr[None] == (1.0, 0.0) and pr[0.9] == (1.0, 0.25) and pr[0.1] == (0.5, 1.0)


def test_pieced_running_totals_equal_one_window(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(s), int(n)) for g in range(2) for s, n in zip(rng.permutation(500) / 7, rng.integers(0, 5, 500))]
    df = spark.createDataFrame(rows, "g int, s double, n int")
    a = running.running_totals(df, "g", "s", ["n"]).collect()
    monkeypatch.setattr(running, "ONE_WINDOW_ROWS", 0)
    b = running.running_totals(df, "g", "s", ["n"], pieces=16).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_binary_only_note(scores):
    assert isinstance(ev.binary_curves(scores, 3), str)
    assert ev.binary_curves(scores, 2).count() == 6


def test_report_with_unpredicted_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    rows = {r["label"]: r for r in ev.class_report(df, "y", "p", ["a", "b", "c"]).collect()}
    assert rows["c"]["precision"] == 0 and rows["c"]["recall"] == 0 and rows["c"]["f1"] == 0
    assert abs(rows["accuracy"]["f1"] - 0.5) < 1e-12 and rows["macro avg"]["support"] == 4
    cells = {(r["actual"], r["predicted"]): r["n"] for r in ev.confusion(df, "y", "p", 3).collect()}
    assert len(cells) == 9 and cells[(2, 1)] == 1 and cells[(2, 2)] == 0


def test_r2_of_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.5), (1.0, 0.5)], "y double, prediction double")
    assert ev.regression_metrics(df, "y").first()["r2"] is None


def test_model_ties_follow_the_catalogue(spark):
    rows = [("regression", "B", 1, 0.5, None), ("regression", "A", 0, 0.5, None), ("classification", "Z", 0, None, 0.0)]
    m = spark.createDataFrame(rows, "task string, model string, catalog_pos int, rmse double, accuracy double")
    got = ev.rank_models(m).collect()
    assert [(r["model"], r["rank"]) for r in got] == [("A", 1), ("B", 2)]
