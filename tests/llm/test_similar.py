"""Near-duplicates at five-word similarity against a comparison of all pairs."""

from __future__ import annotations

import random

from chromaspark.llm import similar, simhash

from test_llm import prose


def plain_set(text: str | None) -> set[tuple[str, ...]]:
    w = (text or "").lower().split()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a: set, b: set) -> float:
    return 1.0 if a == b else len(a & b) / len(a | b)


def edited(text: str, n: int, seed: int) -> str:
    w = text.split(" ")
    for i in random.Random(seed).sample(range(len(w)), n):
        w[i] = f"new{seed}w{i}"
    return " ".join(w)


def cases() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base = [" ".join(f"a{rng.randint(0, 400)}" for _ in range(150)) for _ in range(12)]
    texts: list[str | None] = [None, "", "two words", "Two  WORDS", "one two three four five", base[0].upper(), *base]
    texts += [edited(t, n, 100 * i + n) for i, t in enumerate(base) for n in (1, 2, 3, 4, 6)]
    texts += [prose(1, 30_000), edited(prose(1, 30_000), 300, 1)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(7, base[3]), (7, base[4]), (None, base[5]), (None, "no key at all here now"), (None, "no key at all here now")]


def test_keep_first_equals_all_pairs(spark):
    rows = cases()
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    linked = [(i, j) for j in range(len(rows)) for i in range(j) if alike(sets[i], sets[j]) >= similar.SHARE]
    edited_pairs = sum(sets[i] != sets[j] for i, j in linked)
    for i, j in linked:
        root[find(j)] = find(i)
    groups: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    want = sorted((min(g, key=lambda d: (d is None, d or 0)) for g in groups.values()), key=repr)
    df = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id bigint, text string, place string").repartition(3)
    got = similar.keep_first(df)
    assert edited_pairs > 40 and got.columns == df.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == want
    assert similar.keep_first(df.limit(0)).count() == 0


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    base = " ".join(f"b{i}" for i in range(150))
    near, far = edited(base, 3, 1), edited(base, 12, 2)
    assert alike(plain_set(base), plain_set(near)) >= 0.8 > alike(plain_set(base), plain_set(far))
    df = spark.createDataFrame([(1, base), (2, near), (3, far)], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3]


def test_stages_on_empty_tables_and_without_labels(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id bigint, text string, lang string, file string, at int, place bigint"
    spark.createDataFrame([(1, "a benchmark text of some ten words that is here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, none, str(tmp_path))
        assert left.count() == 0 and left.columns == none.columns
    assert corpus_pipeline.token_ids(spark, none, str(tmp_path)).count() == 0
    rows = [(1, "words in a row", None, "f", 1, 1), (2, None, None, "f", 2, 2), (3, "12 -", None, "f", 3, 3)]
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, kind), "").collect()] == [1]


def test_intermediate_tables_are_deleted(spark):
    import os

    from chromaspark.functions.reuse import session_folder

    rows = spark.createDataFrame([(i, edited(" ".join(f"c{j}" for j in range(80)), min(i, 1), i)) for i in range(6)], "doc_id bigint, text string")
    before = set(os.listdir(session_folder(spark)))
    assert similar.keep_first(rows).count() < 6
    left = {name.split("-")[0] for name in set(os.listdir(session_folder(spark))) - before}
    assert left == {"rows", "files", "extra"}


def test_small_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(8)
    base = " ".join(f"d{rng.randint(0, 999)}" for _ in range(60))
    rows = [(i, edited(base, 1 + i % 3, i)) for i in range(60)]
    rows += [(100 + i, edited(rows[i][1], 1, 1000 + i)) for i in range(0, 60, 5)]  # siblings of copies that lie apart from the base
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if alike(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    want = sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))
    assert 5 < len(want) < 60
    for shingles in (similar.BLOCK_SHINGLES, 100):
        monkeypatch.setattr(similar, "BLOCK_SHINGLES", shingles)
        assert sorted(r["doc_id"] for r in similar.keep_first(df).collect()) == want


def test_fingerprints_alone_link_small_edits(spark, monkeypatch):
    rng = random.Random(9)
    base = " ".join(f"e{rng.randint(0, 9999)}" for _ in range(2000))
    near, far = edited(base, 1, 1), edited(base, 400, 2)
    assert (simhash.fingerprint(base) ^ simhash.fingerprint(near)).bit_count() <= 4
    # one word twice as often: the same set of five-word shingles, another fingerprint
    df = spark.createDataFrame([(1, base), (2, near), (3, far), (4, "w " * 9), (5, "w " * 12), (6, None)], "doc_id bigint, text string")
    monkeypatch.setattr(similar, "bands", lambda found: found[:0])
    assert sorted(r["doc_id"] for r in similar.keep_first(df).collect()) == [1, 3, 4, 6]


def test_whole_texts_travel_in_small_batches(spark, monkeypatch):
    """Near-duplicates must not hold 10,000 texts a task at a time, and the session's setting is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, write = spark.conf.get(name), {}, similar.keep
    monkeypatch.setattr(similar, "keep", lambda df, what="table": seen.setdefault(what, int(spark.conf.get(name))) and write(df, what))
    df = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(40)], "doc_id bigint, text string")
    assert similar.keep_first(df).count() == 20
    assert max(seen["marked"], seen["sets"]) <= 1000 and spark.conf.get(name) == before


def test_pipeline_stages_send_few_texts_at_a_time(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        docs = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
        corpus_pipeline.token_ids(spark, docs, "")
        assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)
