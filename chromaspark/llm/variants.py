"""Spelling variants: Bloom-guided neighbourhoods of a vocabulary.

Each word's edits by one code point (deletions and replacements; insertions are deletions seen from the longer word) are
generated as hashes only, without building strings, and probed against blocked Bloom filters of the words of that
length. The few positives become strings and meet the vocabulary in an exact join, which removes the filters' errors.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chromaspark.llm.common import drop_kept, keep

LEAST_LENGTH = 6  # code points of a word
LEAST_COUNT = 5  # occurrences of a word
LEADS = 5  # times as frequent as a word its form must be
DELETES = 199  # one in so many (document, run) pairs loses a code point

SHARD_WORDS = 1 << 20  # words a Bloom filter is made for, about; a longer list is dealt over more filters
WAVE_BYTES = 64 << 20  # filters that are broadcast at a time
BLOCK_BITS = 512
WORD_BITS = 16  # filter bits a word
PROBES = 6
FLUSH = 300_000  # distinct words counted in a task before they are handed on
PIECE = 1 << 20  # longer texts are read run by run

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))
_LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_CELLS = 1 << 18  # replacements whose hashes are formed at a time


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(text: str) -> str:
    """The text with A-Z in lower case and nothing else changed."""
    return text.encode().translate(_LOWER).decode()


def prefix(doc_id: int | None) -> int:
    """Checksum of ``<doc_id>:``; a null id is empty text."""
    return zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())


def damaged(start: int, run: str, deletes: int = DELETES) -> str:
    """The lower-cased run, without one code point if the checksum of ``<doc_id>:<run>``, which goes on from ``start``, says so."""
    h = zlib.crc32(run.encode(), start)
    if h % deletes:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, key: str, text: str, length: int, count: int, deletes: int) -> DataFrame:
    """``(word, n)``: occurrences are counted within a task first, then over all."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc, value in zip(b.column(0).to_pylist(), b.column(1)):
                t = value.as_py()
                if not t:
                    continue
                if len(t) <= PIECE:
                    found = Counter(_RUN.findall(lowered(t)))
                else:
                    found = Counter(lowered(m.group()) for m in _RUN.finditer(t))
                start = prefix(doc)
                for run, n in found.items():
                    if len(run) < length:
                        continue
                    word = damaged(start, run, deletes)
                    if len(word) >= length:
                        held[word] += n
                if len(held) >= FLUSH:
                    yield handed_on()
        if held:
            yield handed_on()

    counted = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(part, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))), dtype=np.uint64)


def _codes(words: list[str], size: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row: the sum of code point times a power of its place (mixed only when probed)."""
    with np.errstate(over="ignore"):
        return (codes * _powers(codes.shape[1])[: codes.shape[1]]).sum(axis=1, dtype=np.uint64)


def edits(codes: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of all edits of words of one length: ``(kind, hash, row, place, code point)`` in blocks.

    Replacements go to greater code points only (the other word of the pair makes the same pair), and
    deletions within a run of equal code points are made once.
    """
    size = codes.shape[1]
    power, h = _powers(size), word_hashes(codes)
    rows = max(1, _CELLS // (size * len(_LETTERS)))
    letters = len(_LETTERS)
    for at in range(0, len(codes), rows):
        c = codes[at: at + rows]
        row = np.arange(at, at + len(c))
        with np.errstate(over="ignore"):
            terms = c * power[:size]
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            # what follows the deleted place moves one place down; divide by the base with its inverse
            after = (h[at: at + rows, None] - before - terms) * np.uint64(pow(int(_BASE), -1, 1 << 64))
            deleted = before + after
        once = np.ones(c.shape, dtype=bool)
        once[:, 1:] = c[:, 1:] != c[:, :-1]
        i, j = np.nonzero(once)
        yield "delete", deleted[i, j], row[i], j, np.zeros(len(i), np.uint64)
        step = max(1, _CELLS // letters)
        i, j = np.indices(c.shape).reshape(2, -1)
        for s in range(0, len(i), step):
            a, p = i[s: s + step], j[s: s + step]
            with np.errstate(over="ignore"):
                new = h[at + a][:, None] + (_LETTERS[None, :] - c[a, p][:, None]) * power[p][:, None]
            greater = _LETTERS[None, :] > c[a, p][:, None]
            x, y = np.nonzero(greater)
            yield "replace", new[x, y], row[a[x]], p[x], _LETTERS[y]


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(h ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(parts)).astype(np.int64)


def _filter_places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Block of each hash and its places within the block."""
    m = _mix(h)
    block = ((m >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    inside = _mix(m)
    return block, [(inside >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1) for i in range(PROBES)]


def make_filter(h: np.ndarray) -> np.ndarray:
    """Blocked Bloom filter (bytes) of some hashes."""
    blocks = max(1, -(-len(h) * WORD_BITS // BLOCK_BITS))
    bits = np.zeros(blocks * BLOCK_BITS, dtype=bool)
    block, places = _filter_places(h, blocks)
    for p in places:
        bits[block * np.uint64(BLOCK_BITS) + p] = True
    return np.packbits(bits)


def in_filter(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter may hold."""
    block, places = _filter_places(h, len(table) * 8 // BLOCK_BITS)
    left = np.arange(len(h))
    for p in places:
        at = block[left] * np.uint64(BLOCK_BITS) + p[left]
        left = left[(table[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
    return left


def _filters(words: DataFrame, parts: dict[int, int]) -> DataFrame:
    """``(size, part, bits)``: one filter for each shard of the words of each length."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_size: dict[int, list[str]] = {}
            for w in b.column(0).to_pylist():
                by_size.setdefault(len(w), []).append(w)
            for size, some in by_size.items():
                h = word_hashes(_codes(some, size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), size, np.int32)), pa.array(_part_of(h, parts[size]).astype(np.int32)), pa.array(h.view(np.int64))],
                    ["size", "part", "h"],
                )

    def build(group: pa.Table) -> pa.Table:
        h = group.column("h").to_numpy().view(np.uint64)
        return pa.table({"size": group.column("size")[:1], "part": group.column("part")[:1], "bits": pa.array([make_filter(h).tobytes()], pa.binary())})

    dealt = words.select("word").mapInArrow(hashed, "size int, part int, h bigint")
    return dealt.groupBy("size", "part").applyInArrow(build, "size int, part int, bits binary")


def _probe(words: DataFrame, shared, sizes: list[int], parts: dict[int, int]) -> DataFrame:
    """``(word, other)``: edits of words that one of the broadcast filters may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.frombuffer(v, np.uint8) for k, v in shared.value.items()}
        for b in batches:
            by_size: dict[int, list[str]] = {}
            for w in b.column(0).to_pylist():
                by_size.setdefault(len(w), []).append(w)
            for size, some in by_size.items():
                for kind, h, row, place, letter in edits(_codes(some, size)):
                    of = size - (kind == "delete")
                    if of not in sizes:
                        continue
                    part = _part_of(h, parts[of]) if parts[of] > 1 else None
                    for p in range(parts[of]):
                        table = tables.get((of, p))
                        if table is None:
                            continue
                        mine = np.arange(len(h)) if part is None else np.flatnonzero(part == p)
                        hit = mine[in_filter(table, h[mine])]
                        if not len(hit):
                            continue
                        own = [some[r] for r in row[hit]]
                        new = [
                            w[:at] + ("" if kind == "delete" else chr(c)) + w[at + 1:]
                            for w, at, c in zip(own, place[hit].tolist(), letter[hit].tolist())
                        ]
                        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(new, pa.string())], ["word", "other"])

    return words.select("word").mapInArrow(run, "word string, other string")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, other, n, other_n)``, kept: each unordered pair of words of ``(word, n)`` (kept, distinct) one edit apart, once."""
    spark = words.sparkSession
    sizes = {r["size"]: r["count"] for r in words.groupBy(F.char_length("word").alias("size")).count().toLocalIterator()}  # a row for each length
    parts = {size: max(1, -(-n // SHARD_WORDS)) for size, n in sizes.items()}
    filters = keep(_filters(words, parts), "filters")
    shards = filters.select("size", "part", F.octet_length("bits").alias("bytes")).orderBy("size", "part").collect()
    waves, size = [[]], 0
    for s in shards:
        if waves[-1] and size + s["bytes"] > WAVE_BYTES:
            waves.append([])
            size = 0
        waves[-1].append((s["size"], s["part"]))
        size += s["bytes"]
    found = []
    for wave in waves if shards else []:
        lengths = sorted({s for s, _ in wave})
        here = filters.where(F.col("size").isin(lengths)).toLocalIterator()
        shared = spark.sparkContext.broadcast({(r["size"], r["part"]): bytes(r["bits"]) for r in here if (r["size"], r["part"]) in set(wave)})
        asking = words.where(F.char_length("word").isin([*lengths, *(s + 1 for s in lengths)])) if len(waves) > 1 else words
        # probing costs far more than the words' bytes tell, so the tasks do not follow the bytes
        tasks = max(spark.sparkContext.defaultParallelism, int(sum(sizes.values()) // 50_000))
        found.append(keep(_probe(asking.repartition(tasks), shared, lengths, parts), "candidates"))
    if not found:
        drop_kept(filters)
        return keep(words.select("word", F.col("word").alias("other"), "n", F.col("n").alias("other_n")).limit(0), "near")
    candidates = reduce(DataFrame.union, found)
    exact = candidates.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    near = keep(exact.join(words, "word").select("word", "other", "n", "other_n"), "near")
    for df in [filters, *found]:
        drop_kept(df)
    return near


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for kept ``(word, form)``: the last word of each chain of forms, by doubling the steps."""
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = keep(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_kept(now)
        moved = not after.where("moved").isEmpty()
        now = after.drop("moved")
        if not moved:
            return now


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, count: int = LEAST_COUNT,
    leads: int = LEADS, deletes: int = DELETES,
) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)``: the words of ``docs`` with the spelling each is probably a variant of.

    Words are maximal runs of Latin letters (to U+00FF) in lower case (A-Z only), some of which lose a code point
    (:func:`damaged`); those of ``length`` code points and ``count`` occurrences or more take part. ``form`` is the
    commonest word one inserted, deleted or replaced code point away (ties: the smaller), if it is ``leads`` times as common; ``root`` follows forms
    to the last. Null and empty texts have no words; rows are counted one by one, repeated ones and those with a null key
    too; an empty table gives an empty one. Runs may be of any length. Other columns are not looked at.
    """
    words = keep(vocabulary(docs, key, text, length, count, deletes), "words")
    near = near_pairs(words)
    both = near.select("word", "other", "other_n").union(near.select("other", "word", "n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("b"))
    joined = words.join(best, "word", "left").withColumn("led", F.coalesce(-F.col("b.n") >= leads * F.col("n"), F.lit(False)))
    judged = keep(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(F.col("led"), F.col("b.other")).alias("form"), F.when(F.col("led"), -F.col("b.n")).alias("form_n"),
    ), "judged")
    roots = _roots(judged.where("form IS NOT NULL"))
    drop_kept(near)
    drop_kept(words)
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
