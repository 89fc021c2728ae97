"""Steps that read the runs: each dear one is done once, with the results of the plain way."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from chromaspark.models import base, catalog as cat
from chromaspark.operators import clean, split
from chromaspark.plans import given, registry
from chromaspark.schema import QUALITY_CODE, RETENTION, RUN_ID


def test_least_place_is_that_of_the_least_text(spark):
    texts = [None, "", "A", "AA", "B", "F", "N", "Na", "O", "R", "S", "a", "é"]
    rows = [(i, t) for i, pair in enumerate(itertools.combinations_with_replacement(texts, 2)) for t in pair]
    df = spark.createDataFrame(rows, "k int, t string")
    got = df.groupBy("k").agg(F.min("t").alias("t"), F.min(given._place("t", given.RETURN_FLAGS)).alias("p")).collect()
    assert len(got) == 91
    for r in got:
        for i, flag in enumerate(given.RETURN_FLAGS):
            assert (r["t"] == flag) == (r["p"] == 2 * i + 1)


def test_runs_need_no_sorted_minimum(spark):
    plan = given.raw_runs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def _counted(spark, df):
    """``df`` with a counter of the times its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(count, df.schema), seen


def test_dataset_makes_its_rows_once(spark, runs):
    df, seen = _counted(spark, runs)
    ds = clean.load_dataset(df)
    assert ds.df.where(F.col(QUALITY_CODE).isNotNull()).count() == 120 == seen.value


def test_exact_split_makes_its_rows_once(spark):
    df, seen = _counted(spark, spark.range(500).select(F.col("id").alias("run_id")))
    out = split.exact_split(df)
    assert out.columns == ["run_id", "is_test"]
    assert out.where("is_test").count() == 100 and seen.value == 500


def test_distinct_vectors_are_scored_once(spark, ds, monkeypatch):
    table = base.training_table(clean.known_target(ds.df), ds.features, RETENTION, "regression")
    few = clean.known_target(ds.df).withColumn("MolWt", F.when(F.col("MolWt") > 40, F.col("MolWt")).otherwise(F.lit(float("nan"))))
    for name, params in (("DT", {"max_depth": 4}), ("SVR", {"C": 1})):
        model = cat.fit(name, table, params)
        plain = {r[RUN_ID]: round(r["prediction"], 9) for r in model.predict(few).collect()}
        seen = []
        score = type(model).predict
        monkeypatch.setattr(type(model), "predict", lambda self, df: seen.append(df.count()) or score(self, df))
        out = base.predict_distinct(model, few)
        monkeypatch.undo()
        assert out.columns == [*few.columns, "prediction"]
        assert {r[RUN_ID]: round(r["prediction"], 9) for r in out.collect()} == plain
        assert seen[0] == base.distinct_features(few, ds.features).count() < len(plain)


def test_arriving_files_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(registry, "FILE_RUNS", 500)  # sf0.001 has some 6,000 lines
    parts = []
    from chromaspark.streaming import score as stream
    monkeypatch.setattr(stream, "stream_runs", lambda s, folder, schema, files_per_batch: parts.append(
        (s.read.parquet(folder).inputFiles(), files_per_batch)) or s.read.parquet(folder))
    monkeypatch.setattr(stream, "run_batches", lambda runs, lookup, model, cols, out, state: runs.select(RUN_ID).withColumn(
        "prediction", F.lit(0.0)).withColumn("batch", F.lit(0)).write.parquet(out))
    monkeypatch.setattr(registry, "_reg_knn", lambda spark, sf: None)
    got = registry._REGISTRY["stream_knn"](spark, "/root/testdata/sf0.001")
    files, half = parts[0]
    assert len(files) == 2 * half > 4 and got.count() == given.raw_runs(spark, "/root/testdata/sf0.001").count()
