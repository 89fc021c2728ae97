"""Language ID against a plain naive Bayes in Python, and its awkward cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest

from chromaspark.llm import language

WORDS = {"en": "the quick brown fox jumps over lazy dogs", "de": "der schnelle braune fuchs springt über hunde", "fr": "le renard brun saute par dessus été"}


def one_bucket(gram: str) -> int:
    h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
    for c in gram:
        h = (h ^ (0 if c == " " else ord(c))) * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 15
    return h & (language.BUCKETS - 1)


def plain_grams(text: str) -> Counter:
    line = re.sub(r" +", " ", f" {''.join(c if c.isalpha() else ' ' for c in text.lower())} ")
    return Counter(one_bucket(line[i: i + n]) for n in language.ORDERS for i in range(len(line) - n + 1) if line[i: i + n] != " ")


def plain(rows: list) -> list[tuple[str, float]]:
    fit = [(t, la) for k, t, la, _ in rows if la is not None and t is not None and zlib.crc32(("" if k is None else str(k)).encode()) % 3 != 1]
    per = {la: Counter() for _, la in fit}
    for t, la in fit:
        per[la].update(plain_grams(t))
    n = Counter(la for _, la in fit)
    mass = {la: sum(c.values()) + 0.5 * language.BUCKETS for la, c in per.items()}
    out = []
    for _, t, _, _ in rows:
        own = plain_grams(t or "")
        if not own or not per:
            out.append(("und", 0.0))
            continue
        said = {
            la: math.log(n[la] / len(fit)) + sum(k * math.log((c[b] + 0.5) / mass[la]) for b, k in own.items()) for la, c in per.items()
        }
        top = max(said.values())
        out.append((min(la for la, v in said.items() if v > top - 1e-9), 1 / sum(math.exp(v - top) for v in said.values())))
    return out


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), []
    for i in range(90):
        la = rng.choice(list(WORDS))
        out.append((i, rng.choice([" ", ", ", "  "]).join(rng.choice(WORDS[la].split()) for _ in range(rng.randint(1, 9))), la if i % 7 else None, "x"))
    return out + [(90, None, "en", "x"), (91, "12 !!", "fr", "x"), (92, "", None, "x"), (None, "der fuchs", None, "x"), (3, "the lazy", "en", "x"), (3, "the lazy", "en", "x")]


@pytest.mark.parametrize("block", [256, 1])
def test_equals_plain_bayes(spark, rows, block):
    """With one language a block, every pass but the last is a table."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").coalesce(1)
    got = language.identify(df, block=block).collect()
    want = plain(rows)
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(r[0], w[0]) for r, w in zip(rows, want)]
    assert all(abs(r["score"] - w[1]) < 1e-4 for r, w in zip(got, want))


def test_many_labels(spark):
    junk = [(i, "the quick fox", f"label{i}", "x") for i in range(40)]
    df = spark.createDataFrame(junk, "doc_id bigint, text string, lang string, row string").coalesce(1)
    fitted = sorted(f"label{i}" for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1)
    for block in (256, 10):
        got = language.identify(df, block=block).collect()
        # all are tied: the first label by code point, with an equal share
        assert {r["lang_pred"] for r in got} == {fitted[0]}
        assert all(abs(r["score"] - 1 / len(fitted)) < 1e-9 for r in got)
    assert language.keep_known(df).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é.  ") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [" " * 30, "", None, "x" * 41, "aΣ bΣ " * 5]
    want = [plain_grams(t or "") for t in texts]
    for piece in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(language, "PIECE", piece)
        got = [Counter() for _ in texts]
        for bucket, of in language.grams(texts):
            for b, o in zip(bucket.tolist(), of.tolist()):
                got[o][b] += 1
        assert got == want


def test_keep_known_without_labels(spark):
    df = spark.createDataFrame([(1, "the fox", None), (2, "12 3", None), (3, None, None), (4, "", None)], "doc_id bigint, text string, lang string")
    assert [r["doc_id"] for r in language.keep_known(df).collect()] == [1]
    assert language.keep_known(df.limit(0)).count() == 0
