"""Decontamination by rows, and its seeds against all substitution places and a comparison of all alignments."""

from __future__ import annotations

import random
from itertools import combinations

from chromaspark.llm import decontaminate


def hits(mask: str, length: int, differ: tuple[int, ...], places) -> bool:
    return any(all(c == "0" or at + i not in differ for i, c in enumerate(mask)) for at in places if at + len(mask) <= length)


def test_masks_fit_all_substitution_places():
    for n in range(5, 24):  # a stretch of 24 words and more is cut into such ones, of which one has the share
        masks = decontaminate._short_masks(n) if n < 12 else decontaminate.MASKS
        for k in range(n // 5 + 1):
            for differ in combinations(range(n), k):
                assert any(hits(m, n, differ, [0] if n < 12 else range(n)) for m in masks), (n, differ)


def brute_leak(words: list[str], test: list[str]) -> bool:
    need = min(12, len(test))
    for shift in range(-len(test) + 1, len(words)):
        same = [words[i + shift] == w if 0 <= i + shift < len(words) else None for i, w in enumerate(test)]
        for a in range(len(test)):
            for b in range(a + need, len(test) + 1):
                if None not in same[a:b] and 5 * sum(same[a:b]) >= 4 * (b - a):
                    return True
    return False


def test_leaks_equal_all_alignments(spark):
    rng = random.Random(12)
    items = [[f"i{n}x{j}w{i}" for i in range(n)] for n in range(5, 21) for j in range(3)]
    docs = []
    for words in items:
        n = len(words)
        for _ in range(12):
            out = set(rng.sample(range(n), rng.randint(0, n // 5 + 1)))
            a, b = (0, n) if rng.random() < 0.7 else sorted(rng.sample(range(n + 1), 2))
            new = [f"s{rng.randint(0, 9999)}" if i in out else w for i, w in enumerate(words)][a:b]
            around = [[f"d{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 6))] for _ in range(2)]
            docs.append(around[0] + new + around[1])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    want = {(d, d // 12) for d, w in enumerate(docs) if brute_leak(w, items[d // 12])}
    assert got == want and 200 < len(want) < len(docs) - 100


def test_pipeline_stage_drops_only_leaking_rows(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "clean one"), (None, f"see {item}"), (None, None), (4, f"{item} again"), (4, "clean two"), (5, "clean three")]
    df = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id bigint, text string, place string")
    got = corpus_pipeline.decontamination(spark, df, str(tmp_path))
    assert got.columns == df.columns
    left = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert left == sorted([(None, "clean one"), (None, None), (4, "clean two"), (5, "clean three")], key=repr)


def test_benchmark_texts_without_an_id(spark):
    texts = [" ".join(f"q{j}x{i}" for i in range(20)) for j in range(4)]
    bench = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (2, texts[2])], "item_id bigint, text string")
    df = spark.createDataFrame([(i, f"see {t}") for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = decontaminate.leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["matched"]) for r in got} == {(0, None, 20), (1, None, 20), (2, 2, 20)} and len(got) == 3
    assert [r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()] == [3]
