import hashlib
import math

import pytest
from pyspark.sql import functions as F

from chromaspark.operators import split


def h(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def skewed(spark):
    """A class with a third of the rows, several small ones."""
    return spark.range(900).select(
        F.col("id").alias("run_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 5).cast("int").alias("c"))


def test_hash_split_matches_definition(skewed):
    for r in split.hash_split(skewed).collect():
        assert r["is_test"] == (h(42, r["run_id"]) % 100 < 20)


def test_exact_split_takes_lowest_hashes(skewed, monkeypatch):
    rows = [r["run_id"] for r in skewed.collect()]
    want = set(sorted(rows, key=lambda k: (h(42, k), k))[: math.ceil(0.2 * len(rows))])
    got = {r["run_id"] for r in split.exact_split(skewed).where("is_test").collect()}
    assert got == want
    monkeypatch.setattr(split, "SMALL_GROUP", 0)  # force every narrowing step
    again = {r["run_id"] for r in split.exact_split(skewed).where("is_test").collect()}
    assert again == want


def test_stratified_quota_and_partition_invariance(skewed):
    counts = {r["c"]: r["count"] for r in skewed.groupBy("c").count().collect()}
    quota = split.class_quotas(counts, 0.2)
    assert sum(quota.values()) == math.ceil(0.2 * 900)
    base = None
    for parts in (1, 4, 64):
        rows = split.stratified_split(skewed.repartition(parts), "c").where("is_test").collect()
        ids = sorted(r["run_id"] for r in rows)
        base = base or ids
        assert ids == base
    for c, n in quota.items():
        assert sum(1 for r in rows if r["c"] == c) == n


def test_split_refuses_too_few_test_rows(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(8)], "run_id int, c int")
    with pytest.raises(ValueError):
        split.stratified_split(df, "c")


def test_stratified_folds_rank(skewed):
    got = {r["run_id"]: r["fold"] for r in split.stratified_folds(skewed, "c").collect()}
    by_class = {}
    for r in skewed.collect():
        by_class.setdefault(r["c"], []).append(r["run_id"])
    for ids in by_class.values():
        for place, k in enumerate(sorted(ids, key=lambda k: (h(43, k), k))):
            assert got[k] == place % 3


def test_fold_count():
    assert [split.fold_count(n) for n in (1, 2, 3, 50)] == [2, 2, 3, 3]
