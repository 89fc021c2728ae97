"""What a task of the forest search hands on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chromaspark.llm import forest


def test_best_rows_keep_ties_and_drop_repeats():
    rep, hit = np.array([1, 1, 1, 1, 1, 2, 2]), np.array([5, 6, 5, 7, 8, 5, 5])
    score = np.array([3.0, 2.0, 3.0, 2.0, 1.0, 9.0, 9.0])
    rows, reached = forest.best_rows(rep, hit, score, 2)
    assert list(zip(*(c.tolist() for c in rows))) == [(1, 5, 3.0), (1, 6, 2.0), (1, 7, 2.0), (2, 5, 9.0)]
    assert reached == [(1, 2.0)]
    none = np.zeros(0, np.int64)
    assert [len(c) for c in forest.best_rows(none, none, np.zeros(0), 3)[0]] == [0, 0, 0]


def test_a_task_hands_on_a_query_few_rows(spark, monkeypatch):
    rng, n, k = np.random.default_rng(4), 3000, 5
    x = rng.normal(size=(n, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").coalesce(1)
    plain, made, answers = type(df).mapInArrow, [], []

    def counted(self, f, schema, *a, **b):
        out = plain(self, f, schema, *a, **b)
        if "hit bigint" not in (schema if isinstance(schema, str) else ""):
            return out
        rows = out.persist()
        made.append((rows.count(), rows.rdd.getNumPartitions()))
        return rows

    monkeypatch.setattr(type(df), "mapInArrow", counted)
    for held in (forest.HELD_ROWS, 300):  # the second hands rows on before a task ends
        monkeypatch.setattr(forest, "HELD_ROWS", held)
        got = forest.search(df, F.col("id") % 20 == 0, k=k, leaf_rows=32, recall=1.0).orderBy("query_id", "rank").collect()
        answers.append([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got])
    assert made[0][0] <= 150 * (k + 1) * made[0][1]
    assert answers[0] == answers[1] and len(answers[0]) == 150 * k
    assert {q for q, *_ in answers[0]} == set(range(0, n, 20))
    for q in (0, 1500, 2980):
        s = forest.inner(np.repeat(x[q][None], n, axis=0), x)
        have = [v for a, _, v, _ in answers[0] if a == q]
        want = [int(i) for i in np.lexsort((np.arange(n), -s)) if i != q][:k]
        assert len(set(want) & set(have)) >= k - 1
