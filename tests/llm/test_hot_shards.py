"""Sharding of a table in which a few rows are repeated very often."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from chromaspark.llm import shards


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_hot_rows_are_scattered(spark, tmp_path, monkeypatch, few):
    """No bucket holds a hot row's copies together; with ``few`` 0 the hot rows are joined by a shuffle."""
    monkeypatch.setattr(shards, "MAX_BROADCAST_HOT", few)
    texts = ["y" * 50] * 3000 + ["z" * 200] * 1500 + [None] * 700 + [f"row {i}" for i in range(300)]
    df = spark.createDataFrame([(7 if i < 5200 else i, t, "b") for i, t in enumerate(texts)], "doc_id bigint, text string, bucket string").repartition(5)
    folder = shards.write_shards(df, 7, folder=str(tmp_path / "s"), bucket_bytes=20_000)
    buckets = -(-sum(len(t or '') + 1 for t in texts) // 20_000)
    sizes = [r["b"] for r in spark.read.parquet(f"{folder}/buckets").groupBy("bucket").agg({"size": "sum"}).toDF("bucket", "b").collect()]
    assert len(sizes) == buckets and max(sizes) < 40_000
    out = shards.read_shards(spark, folder, df.schema).select("shard", "slot", "size", "row.text", "row.bucket").collect()
    assert Counter(r["text"] for r in out) == Counter(texts) and {r["bucket"] for r in out} == {"b"}
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
