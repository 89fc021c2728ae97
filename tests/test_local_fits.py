"""Fits of packed rows in one task, and the same fits with a job for each step."""

import numpy as np
import pytest

from chromaspark.functions import descent
from chromaspark.models import catalog as cat, kernel, mlp
from chromaspark.models.base import training_table


def rows(spark, task):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, size=(400, 2)).astype(float)
    y = x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400) if task == "regression" else (x[:, 0] > x[:, 1]).astype(float)
    df = spark.createDataFrame([(i, *map(float, v), float(t), i % 3) for i, (v, t) in enumerate(zip(x, y))],
                               "run_id bigint, a double, b double, t double, fold int")
    return training_table(df, ["a", "b"], "t", task, 2 if task == "classification" else 0)


@pytest.mark.parametrize("name, task", [("SVC", "classification"), ("MLP", "regression"), ("MLPC", "classification")])
def test_no_job_for_each_step(spark, monkeypatch, name, task):
    table, params = rows(spark, task), {"C": 1} if name == "SVC" else {"hidden_layer_sizes": (4,), "max_iter": 15}
    monkeypatch.setattr(descent, "LOCAL_ROWS", 0)
    far = cat.fit(name, table, params)
    monkeypatch.setattr(descent, "LOCAL_ROWS", 1_000)

    def step(*_):
        raise AssertionError("a job for a step of a small fit")

    monkeypatch.setattr(descent, "row_sums", step)
    for module in (kernel, mlp):
        monkeypatch.setattr(module, "row_sums", step, raising=False)
    here = cat.fit(name, table, params)
    assert np.allclose(here.history, far.history, rtol=1e-7)


def test_svr_blocks_hold_each_vector_once(spark):
    table = rows(spark, "regression")
    blocks = kernel._vector_blocks(table.rows, table.features, "y").collect()
    n = np.concatenate([np.frombuffer(b["n"]) for b in blocks])
    y = np.concatenate([np.frombuffer(b["y"]) for b in blocks])
    x = np.concatenate([np.frombuffer(b["x"]).reshape(-1, 2) for b in blocks])
    assert n.sum() == len(y) == 400
    want = sorted((r["a"], r["b"], r["y"]) for r in table.rows.collect())
    assert sorted(zip(*np.repeat(x, n.astype(int), axis=0).T, y)) == want
