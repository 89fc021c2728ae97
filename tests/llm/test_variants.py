"""Spelling variants against a comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from chromaspark.llm import variants


def apart_by_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    n: Counter[str] = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form: dict[str, str] = {}
    out = []
    for w, k in words.items():
        near = sorted((-m, o) for o, m in words.items() if apart_by_one(w, o))
        if near and -near[0][0] >= 5 * k:
            form[w] = near[0][1]
        out.append((w, k, len(near)))
    result = []
    for w, k, near in out:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        result.append((w, f, root, k, near, words[f] if f else None))
    return sorted(result)


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeé÷ÿ") for _ in range(rng.randint(6, 9))) for _ in range(40)] + ["x" * 3000, "aaaaaaa", "aaaaaaaa"]
    rows: list[tuple[int | None, str | None]] = [(None, None), (1, ""), (2, "É123é"), (3, "a" * 5)]
    for i in range(400):
        some = []
        for _ in range(rng.randint(5, 60)):
            w = stems[min(int(rng.expovariate(0.12)), len(stems) - 1)]
            if rng.random() < 0.25:
                at = rng.randrange(len(w) if len(w) < 100 else 3)
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abzß") + w[at:], w[:at] + rng.choice("aeo") + w[at + 1:]])
            some.append(w.upper() if rng.random() < 0.2 and w.isascii() else w)
        rows.append((i if i % 50 else None, rng.choice([" ", ", ", "-", "5"]).join(some)))
    rows += [(500 + i, " ".join(["chainaaa"] * 8 + ["chainaab"] * 60 + ["chainabb"] * 500)) for i in range(4)]
    return rows + rows[10:14] + [(7, (stems[0] + " ") * 200_000)]


@pytest.mark.parametrize("shard, wave", [(variants.SHARD_WORDS, variants.WAVE_BYTES), (20, 128)])
def test_equals_all_pairs(spark, monkeypatch, shard, wave):
    monkeypatch.setattr(variants, "SHARD_WORDS", shard)
    monkeypatch.setattr(variants, "WAVE_BYTES", wave)
    rows = texts()
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    got = variants.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n")
    want = plain(rows)
    assert len(want) > 200 and sum(r[1] is not None for r in want) > 30 and any(r[2] not in (r[0], r[1]) for r in want)
    assert sorted(map(tuple, got.collect())) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert variants.spelling_variants(df).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, "six letters once")], "doc_id bigint, text string")).count() == 0


def test_runs_as_stated():
    assert variants._RUN.findall("a×b÷c ÀÿĀ") == ["a×b÷c", "Àÿ"]
