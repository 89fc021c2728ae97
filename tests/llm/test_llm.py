"""Operators of the llm subpackage against plain versions, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chromaspark.llm import bpe, chat, decontaminate, edit_counts, forest, language, shards, simhash, token_files, url_lists
from chromaspark.llm.components import components
from chromaspark.llm.pieces import WholeTextEncoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, n_tokens string, fingerprint int, shard string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["stone", "river", "of", "the", "cloud", "green", "walks", "été", "Über", "don't", "12,5"]) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


ODD = ["", " ", "a", "  two  spaces ", "tab\tand\nline", "<|endoftext|> x<|endoftext|>", "ΟΔΟΣ ΑΣ", "日本 語", "x" * 700, "?!... --", "é é", "b\x1cc"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, *ODD, *[prose(i, 20 + 7 * i) for i in range(12)], prose(3, 41), prose(99, 30_000), None]
    rows = [(i, t, "en" if i % 2 else None, "n", 1, "s") for i, t in enumerate(texts)]
    rows += [(5, texts[5], "fr", "n", 2, "s")] * 3 + [(None, prose(4, 48), None, "n", 3, "s")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def random_texts(n: int) -> list[str]:
    rng = random.Random(1)
    letters = "aΣé '\n\t.!?1٣日　́<|endoftext|>x​S \x1f"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_encoders_equal_the_library():
    word, byte = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    mine, whole = bpe.WordBpe(WORDS), WholeTextEncoder(BYTES, 4, room=50)  # so small a cache is emptied often
    for t in [*ODD, *random_texts(1500), prose(1, 300), "ab" * 400]:
        ids = word.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.decode(ids) == word.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(whole.encode(t), "<u4").tolist() == byte.encode(t, add_special_tokens=False).ids


def test_op1_files(spark, docs, rows, none):
    folder = token_files.write_token_files(docs, BYTES, 2, sequence=8, per_batch=4)
    got = {(r["doc_id"], r["start"]): r for r in token_files.read_token_files(spark, folder).collect()}
    assert len(got) == len(rows)
    library = Tokenizer.from_file(BYTES)
    expect = defaultdict(list)
    for d, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        expect[d].append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for d in sorted(expect, key=lambda x: (x is not None, x or 0)):
        for n, crc in expect[d]:
            r = got[(d, start)]
            assert (r["n_tokens"], r["ids_crc32"]) == (n, crc)
            start += n
    path = spark.read.parquet(f"{folder}/index").where("n_tokens > 100").first()["file"]
    data = token_files.TokenFile(path)
    assert data.sequence(0).shape == (8,) and data.sequence(0).base is not None and data.mask(0).all()
    with pytest.raises(IndexError):
        data.sequence(len(data))
    assert token_files.read_token_files(spark, token_files.write_token_files(none, BYTES, 2)).count() == 0


def test_op2_digests(docs, rows, none):
    got = sorted(map(tuple, bpe.digests(bpe.encode_decode(docs, WORDS)).collect()), key=repr)
    library, want = Tokenizer.from_file(WORDS), []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)]))
    assert got == sorted(want, key=repr)
    assert bpe.digests(bpe.encode_decode(none, WORDS)).count() == 0


def test_op1_paths_have_the_scheme_spark_gives_them(spark, docs, tmp_path, monkeypatch):
    assert token_files.qualified(spark, f"{tmp_path}/a b") == f"file:{tmp_path}/a b"
    folder = token_files.write_token_files(docs, BYTES, 2, folder=f"{tmp_path}/a b")
    files = [r["file"] for r in spark.read.parquet(f"{folder}/index").select("file").distinct().collect()]
    assert files and all(f.startswith(f"file:{tmp_path}/a b/data/") for f in files)
    assert token_files.read_token_files(spark, folder).count() == docs.count()
    for path in ("/x/y", "file:/x/y", "file:///x/y"):
        store, name = token_files._filesystem(path)
        assert store.type_name == "local" and name == "/x/y"
    monkeypatch.setattr(token_files, "_SCHEMES", {"hdfs": "hdfs"})
    with pytest.raises(ValueError, match="known schemes"):
        token_files.qualified(spark, "/x")


def test_op3_maximal_conversations(spark):
    turns = {
        1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a"], 5: ["x"], 6: ["a", "c"], 7: [None, "b"], 8: [""], None: ["z", "z"],
    }
    rows = [(c, i, "user" if i % 2 == 0 else None, t, "q") for c, ts in turns.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, pos string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 5, 6, 7, 8}  # rows without an id are no conversation
    assert got[2]["n_copies"] == 2 and got[2]["n_turns"] == 3
    assert got[6]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>unknown\nc<|im_end|>"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_op4_as_of_lists(spark):
    entries = spark.createDataFrame([
        ("l", "domain:bad.org", "2024-01-10", "add"), ("l", "domain:bad.org", "2024-01-10", "add"), ("l", "domain:bad.org", "2024-02-10", "remove"),
        ("l", "domain:bad.org", "2024-06-01", "add"), ("p", "path:ok.org/x", "2024-01-01", "add"), ("l", None, "2024-01-01", "add"),
    ], "list string, pattern string, day string, action string").withColumn("day", F.col("day").cast("date"))
    cases = [
        ("http://www.Bad.org/a?b", "2024-01-09", 0), ("http://www.bad.org:80/a", "2024-01-10", 1), ("https://u@bad.org", "2024-02-09", 1),
        ("http://bad.org/", "2024-02-10", 0), ("http://bad.org/", "2025-01-01", 1), ("http://notbad.org/", "2024-01-15", 0),
        ("http://ok.org/x/y#z", "2024-05-05", 1), ("http://ok.org/xy", "2024-05-05", 0), (None, "2024-05-05", 0), ("http://bad.org/", None, 0),
        ("", "2024-05-05", 0), ("http://bad.org/", "2025-01-01", 1),
    ]
    captures = spark.createDataFrame([(u, d, n, "x") for u, d, n in cases], "url string, fetched_on string, want int, hits string")
    captures = captures.withColumn("fetched_on", F.col("fetched_on").cast("date"))
    got = url_lists.filter_urls(captures, entries).select("capture.want", "verdict.hits").collect()
    assert len(got) == len(cases) and all(r["want"] == r["hits"] for r in got)
    assert url_lists.filter_urls(captures, entries.limit(0)).where("verdict.hits <> 0").count() == 0
    assert url_lists.filter_urls(captures.limit(0), entries).count() == 0


def test_op5_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 12)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[40:44] = x[20]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(9001, None, "a"), (9002, [0.0] * 12, "a"), (9003, [float("nan")] * 12, "a"), (9004, [1.0], "a")]
    rows += [(7, x[7].tolist(), "a")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    got = defaultdict(list)
    for r in forest.search(df, F.col("id") % 20 == 0, k=10, leaf_rows=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = forest.inner(np.repeat(x[q][None], len(x), axis=0), x)
        assert all(abs(s[v] - p) == 0 for v, p in found) and q not in dict(found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        s[q] = -np.inf
        hits += len({v for v, _ in found} & set(np.lexsort((np.arange(len(x)), -s))[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9
    few = forest.search(df.where("vec_id < 5"), F.col("id") % 20 == 0, k=10).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert forest.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_op6_shards(spark, docs, rows, none):
    got = shards.read_shards(spark, shards.write_shards(docs, 5, bucket_bytes=4000), docs.schema)
    out = got.select("shard", "slot", "size", "row.doc_id", "row.text", "row.shard").toDF("shard", "slot", "size", "doc_id", "text", "own").collect()
    assert sorted([(r["doc_id"], r["text"]) for r in out], key=repr) == sorted(rows, key=repr)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["own"] == "s"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = shards.read_shards(spark, shards.write_shards(docs.repartition(3), 5, bucket_bytes=4000), docs.schema)
    order = lambda d: [(r["doc_id"], r["text"]) for r in d.orderBy("shard", "slot").select("row.doc_id", "row.text").collect()]
    assert order(got) == order(again)
    assert shards.read_shards(spark, shards.write_shards(none, 5), none.schema).count() == 0


def test_op7_counts_follow_edits(spark, docs, none):
    library = Tokenizer.from_file(BYTES)
    count = edit_counts.counter(BYTES)
    rng = random.Random(3)
    for t in [*ODD, *[prose(i, 200) for i in range(8)]]:
        for _ in range(8):
            edits = sorted((a := rng.randint(0, len(t)), a + rng.choice([0, 1, 5, 300]), rng.choice(["", " ", "x", "\n", " new w", "'s", "  ", "1"])) for _ in range(4))
            held = edit_counts.EditedText.new(t, count)
            new, _ = held.apply(edits)
            assert held.tree.total() == len(library.encode(new, add_special_tokens=False).ids)
    edits = spark.createDataFrame([
        (14, 3, 9, "AND"), (14, 3, 9, "AND"), (14, 5, 6, "over"), (14, 100_000, 5, "!"), (26, 60_000, 60_010, None), (777, 0, 1, "x"), (None, 0, 1, "x"),
    ], "doc_id bigint, start int, end int, replacement string")
    got = {(r["doc_id"], r["text"]): r for r in edit_counts.apply_edits(edit_counts.build(docs, BYTES), edits, BYTES).collect()}
    assert all(r["n_tokens"] == len(library.encode(r["text"], add_special_tokens=False).ids) for r in got.values())
    long = next(r for (d, _), r in got.items() if d == 26)
    assert long["n_edits"] == 1 and 0 < long["n_encoded"] < 2000
    assert next(r for (d, _), r in got.items() if d == 14)["n_skipped"] >= 2
    assert edit_counts.apply_edits(edit_counts.build(none, BYTES), edits, BYTES).count() == 0
    assert edit_counts.apply_edits(edit_counts.build(docs, BYTES), edits.limit(0), BYTES).where("n_tokens <> n_before").count() == 0


def test_op7_rounds_follow_each_other(spark, docs):
    library = Tokenizer.from_file(BYTES)
    count = edit_counts.counter(BYTES)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(7)
    for t in [*ODD, *[prose(i, 1500) for i in range(3)]]:
        held = edit_counts.EditedText.new(t, count)
        leaves = len(held.starts)
        for _ in range(12):
            n = len(held.text)
            edits = sorted((a := rng.randint(0, n), a + rng.choice([0, 1, 5, 700, n]), rng.choice(["", " ", "x", " new w", "'s", "  ", "ab cd " * 200])) for _ in range(3))
            before = held.text
            new, _ = held.apply(edits)
            assert held.text == new and len(held.starts) == leaves and held.starts == sorted(held.starts) and held.starts[0] == 0
            assert held.tree.total() == size(new), (before, edits)
            ends = [*held.starts[1:], len(new)]
            assert [int(v) for v in held.tree.nodes[held.tree.size:][:leaves]] == [size(new[a:b]) for a, b in zip(held.starts, ends)]
    first = spark.createDataFrame([(26, 60_000, 60_010, "one"), (14, 3, 9, "AND")], "doc_id bigint, start int, end int, replacement string")
    second = spark.createDataFrame([(26, 60_005, 60_300, " two "), (26, 10, 10, "z")], "doc_id bigint, start int, end int, replacement string")
    once = edit_counts.apply_edits(edit_counts.build(docs, BYTES), first, BYTES, with_state=True)
    twice = edit_counts.apply_edits(once, second, BYTES).collect()
    assert all(r["n_tokens"] == size(r["text"]) for r in twice)
    long = next(r for r in twice if r["doc_id"] == 26)
    assert long["n_edits"] == 2 and 0 < long["n_encoded"] < 3000
    assert next(r for r in twice if r["doc_id"] == 14)["n_encoded"] == 0


def test_op8_leaks(spark, docs, none):
    rng = random.Random(8)
    words = [f"w{i}x{rng.randint(0, 9)}" for i in range(4000)]
    item = words[:40]
    close = [w if i % 6 else "other" for i, w in enumerate(item)]
    bench = spark.createDataFrame([
        (1, " ".join(item)), (2, "only four words here"), (3, None), (4, " ".join(words[50:57])), (1, " ".join(item)), (5, "")], "item_id bigint, text string")
    texts = {
        10: " ".join(words[100:300] + item + words[300:400]), 11: " ".join(words[400:450] + close + words[500:550]).upper(),
        12: " ".join(words[600:800]), 13: "> " + ", ".join(words[50:57]) + ".", 14: " ".join(item[:8] + words[900:990]), 15: None, 16: "",
        17: " ".join(item[10:24]), 18: " ".join(words[1000:3000] * 30 + item),
    }
    df = spark.createDataFrame([(d, t, "q") for d, t in texts.items()] + [(10, texts[10], "q")] * 2, "doc_id bigint, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["span"]) for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 4), (17, 1), (18, 1)}
    assert got[(10, 1)] == (40, 40) and got[(17, 1)] == (14, 14) and got[(11, 1)][0] >= 0.8 * got[(11, 1)][1]
    left = decontaminate.keep_clean(df, bench)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [12, 14, 15, 16]
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.leaks(df.limit(0), bench).count() == 0
    nulls = spark.createDataFrame([(None, "x"), (None, " ".join(item)), (3, "y")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in decontaminate.keep_clean(nulls, bench).collect()] == [3]


def plain_fingerprint(text: str | None) -> int:
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    s = [" ".join(w[i: i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(values: list[int], radius: int) -> dict[int, int]:
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    return {v: find(v) for v in root}


def test_op9_near_duplicates(spark, docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    fps = {t: plain_fingerprint(t) for _, t in rows}
    comp = plain_components(list(fps.values()), 4)
    first: dict[int, int] = {}
    for d, t in rows:
        c = comp[fps[t]]
        if d is not None:
            first[c] = min(d, first.get(c, d))
    want = sorted([(d, f"{fps[t]:016x}", first[comp[fps[t]]]) for d, t in rows], key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    left = simhash.keep_first(docs)
    assert left.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(comp[fps[t]] for _, t in kept) == sorted(set(comp.values()))
    assert {d for d, _ in kept} == set(first.values())
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_op9_ball_joins_find_every_link(spark):
    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:30]:
        for n in range(1, 7):
            x = v
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            values.append(x)
    values = sorted(set(values))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    stars = components(simhash.linked_pairs(spark.createDataFrame([(signed(v),) for v in values], "fp bigint"), 4))
    low = {r["u"]: r["v"] for r in stars.collect()}
    mine = defaultdict(set)
    for v in values:
        mine[low.get(signed(v), signed(v))].add(v)
    plain = defaultdict(set)
    for v, r in plain_components(values, 4).items():
        plain[r].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))
    with pytest.raises(ValueError):
        simhash.linked_pairs(spark.range(1), 3)


@pytest.mark.parametrize(("radius", "blocks"), [(2, 7), (4, 7), (4, 10), (4, 16), (2, 32), (6, 7)])
def test_op9_buckets_and_passes_lose_no_link(monkeypatch, radius, blocks):
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(4)] + [rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)]
    values = set(base)
    for v in base:
        for n in range(1, 9):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), n)))
    x = np.array(sorted(values), dtype=np.uint64)
    ball = simhash._Ball(radius // 2, blocks)
    assert len(ball.codes) == sum(math.comb(blocks, i) for i in range(radius // 2 + 1))
    held = defaultdict(list)
    for bucket, packed in ball.send(x):
        held[bucket].append(np.frombuffer(packed, np.uint64))
    found = []
    for limit in (simhash.PASS_VARIANTS, 40):
        monkeypatch.setattr(simhash, "PASS_VARIANTS", limit)
        edges, calls = set(), 0
        for bucket, parts in held.items():
            for part in simhash.bucket_links(bucket, np.unique(np.concatenate(parts)), radius // 2, blocks):
                edges |= set(map(tuple, part.tolist()))
                calls += 1
        assert calls == len(held) if limit > 40 else calls > len(held) or blocks > 7 or radius < 4
        assert all((a ^ b).bit_count() <= radius for a, b in edges)
        found.append(edges)
    root = {int(v): int(v) for v in x}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    assert found[0] == found[1]
    for a, b in found[0]:
        root[find(b)] = find(a)
    groups = lambda of: sorted(sorted(v for v in root if of(v) == r) for r in {of(v) for v in root})
    plain = plain_components([int(v) for v in x], radius)
    assert groups(find) == groups(plain.get)


def test_op9_blocks_follow_the_fingerprints():
    assert simhash.block_count(0, 2) == simhash.block_count(1_000_000, 2) == simhash.LEAST_BLOCKS
    for n in (10**7, 15 * 10**6, 10**9, 10**12):
        b = simhash.block_count(n, 2)
        sent = 1 + b + b * (b - 1) // 2
        assert n * sent / 2**b <= simhash.BUCKET_HELD and 8 * sent < (500 if n < 16 * 10**6 else 4000)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def test_op10_language(spark, docs, none):
    say = {"en": "the quick brown fox jumps over lazy dogs and then ", "de": "der schnelle braune fuchs springt über den hund und "}
    rng = random.Random(2)
    rows = []
    for i in range(200):
        lang = "en" if i % 2 else "de"
        w = say[lang].split()
        rows.append((i, " ".join(rng.choice(w) for _ in range(12)), lang, "x"))
    rows += [(900, None, "en", "x"), (901, "12 34 !!", "de", "x"), (902, "", None, "x"), (903, "the fox " * 200_000, None, "x"), (None, "der hund und", None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") and 0.5 < got[i]["score"] <= 1 for i in range(200))
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "de"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(200))
    left = language.keep_known(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {*range(200), 903, None}
    unlabelled = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    assert language.identify(none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"q{i}" for i in range(30))
    texts = [prose(i, 60) for i in range(20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [
        (50, texts[3], "en", "s", 1), (51, texts[5] + " " + item + " " + texts[6], "en", "s", 1), (52, "123 !!", "en", "s", 1), (53, None, None, "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(20))
