"""The forest search sends no side of a join to the driver, and its groups keep the best rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chromaspark.llm import forest


def test_nothing_that_grows_with_the_table_is_broadcast(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 6)))]
    got = forest.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("id") % 20 == 0, k=4, leaf_rows=64)
    assert len(got.collect()) == 60 * 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_a_group_keeps_the_best_rows_met(monkeypatch):
    rng, most = np.random.default_rng(6), 4
    q, x = rng.integers(-3, 4, (7, 3)).astype(float), rng.integers(-3, 4, (50, 3)).astype(float)
    for held in (forest.HELD_ROWS, 20):
        monkeypatch.setattr(forest, "HELD_ROWS", held)
        best, met = forest._Best(q, x, most), np.zeros((7, 50), bool)
        for _ in range(12):
            qs, xs = rng.choice(6, 3, replace=False), rng.choice(50, 8, replace=False)
            best.meet(qs, xs)
            met[np.ix_(qs, xs)] = True
        score = q @ x.T
        want = {(i, j, score[i, j]) for i in range(7) for j in np.flatnonzero(met[i]) if score[i, j] >= sorted(score[i, met[i]])[-min(most, met[i].sum())]}
        assert set(zip(*(c.tolist() for c in best.rows()))) == want
