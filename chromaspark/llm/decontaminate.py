"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of the words in a window and ignore the others, so a window still matches when a
word at an ignored place was replaced. Window hashes of the training texts that pass a filter of the
benchmark's hashes are joined with them in Spark; each hit fixes an alignment of the two texts, which
is then compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chromaspark.llm.common import keep, outlive, placed, scratch, text_batches

# Masks over windows of words: 1 is compared, 0 ignored. One of them fits every stretch of 12 words with two others, of 15 with
# three and of 20 with four (tests/llm/test_leaks.py counts them all); every longer stretch within the share holds one of these.
MASKS = ("11010111", "1110001011", "1101000111", "111111")
LEAST_WORDS = 5  # benchmark texts with fewer words say nothing and are not searched
SPAN = 12  # words an overlap has at the least (the whole text, if that is shorter)
SHARE = 0.8  # of them that agree
FILTER_BITS = (1 << 20, 1 << 29)

_PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers = tuple(
                np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))), dtype=np.uint64)
                for b in (_BASE, inverse)
            )
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_piece(data: bytes) -> np.ndarray:
    """64-bit hashes of the words (letters and digits) of lower-cased UTF-8 text."""
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    word = _WORD[raw]
    high = np.flatnonzero((raw == 0xC2) | (raw == 0xE2) | (raw == 0xE3))
    if len(high):  # Latin-1 signs, general punctuation and CJK punctuation part words, too
        nxt = raw[high + 1]
        sign = high[(raw[high] == 0xC2) & (nxt != 0xAA) & (nxt != 0xB5) & (nxt != 0xBA)]
        word[sign] = word[sign + 1] = False
        wide = high[((raw[high] == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))) | ((raw[high] == 0xE3) & (nxt == 0x80))]
        word[wide] = word[wide + 1] = word[np.minimum(wide + 2, len(raw) - 1)] = False
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
        h = (total[end] - total[start]) * down[start]
    return _mix(h ^ (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words in order; case and punctuation do not matter."""
    data = (text or "").lower().encode()
    if len(data) <= _PIECE:
        return _hash_piece(data)
    out, at = [], 0
    while at < len(data):
        cut = data.find(b" ", at + _PIECE)
        cut = len(data) if cut < 0 else cut
        out.append(_hash_piece(data[at:cut]))
        at = cut
    return np.concatenate(out)


def _many(texts: list[str]) -> Iterator[np.ndarray]:
    """:func:`word_hashes` of each text; short ones are hashed together."""
    run, size = [], 0
    for t in [*texts, None]:
        data = None if t is None else t.lower().encode()
        if data is None or size + len(data) > _PIECE:
            if run:
                # a word of its own after each text shows where it ends
                mark = _hash_piece(b"\xff")[0]
                h = _hash_piece(b" \xff ".join(run) + b" \xff")
                ends = np.flatnonzero(h == mark)
                first = 0
                for e in ends:
                    yield h[first:e]
                    first = e + 1
            run, size = [], 0
        if data is None:
            return
        if len(data) > _PIECE:
            yield word_hashes(t)
        else:
            run.append(data)
            size += len(data)


def _window_hashes(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of each window of ``words`` under one mask."""
    m = len(words) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, number + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                h = h * np.uint64(_BASE) + words[i: i + m]
    return _mix(h)


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for shift in (0, 17, 34):
        yield (h >> np.uint64(shift)) & np.uint64(bits - 1)


def _short_masks(n: int, share: float = SHARE) -> list[str]:
    """Masks over all of a text of ``n`` words, below ``SPAN``: whichever words may differ, one of the masks ignores them."""
    size = 1 if n == LEAST_WORDS else 2  # neighbouring places are ignored together
    groups = range(-(-n // size))
    differ = n - int(np.ceil(share * n - 1e-9))
    return ["".join("0" if i // size in out else "1" for i in range(n)) for out in combinations(groups, differ)]


def _masks(lengths: list[int], share: float = SHARE) -> list[tuple[str, int]]:
    """(mask, length of the benchmark texts it is for): the fixed masks, for all of ``SPAN`` words and more (0), and those of each shorter length."""
    return [*((m, 0) for m in MASKS), *((m, n) for n in sorted(lengths) for m in _short_masks(n, share))]


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_hashes(t.as_py()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], ["item", "words"])

    got = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text"))
    got = got.mapInArrow(run, "item bigint, words array<bigint>").where(F.size("words") >= LEAST_WORDS)
    return got.distinct()


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    span: int = SPAN, share: float = SHARE,
) -> DataFrame:
    """``(key, item_id, matched, span)``: documents that hold part of a benchmark text, one row for each such pair.

    Two texts overlap if, in one alignment without gaps, some stretch of at least ``span`` words (or the
    whole benchmark text, if shorter) agrees in at least ``share`` of its words. Words are compared
    without case and punctuation. ``matched`` and ``span`` describe the longest such stretch, from its first
    to its last equal word. The seeds find all overlaps of the default ``span`` and ``share``, or stricter ones.
    Null and empty texts have no words and never match; benchmark texts of fewer than five words are
    left out, those without an id are reported under the null id. Rows that share a key are reported together, repeated rows once. Either table may be empty.
    Other columns are not looked at.
    """
    spark = docs.sparkSession
    items = keep(_items(benchmark, item, item_text).withColumn("number", F.monotonically_increasing_id()), "items")
    sizes = items.select(F.size("words").alias("n")).agg(
        F.max("n").alias("longest"), F.collect_set(F.when(F.col("n") < SPAN, F.col("n"))).alias("short")
    ).first()  # at most seven short lengths
    masks, reach = _masks(sizes["short"] or []), int(sizes["longest"] or 0)
    widest = max(len(m) for m, _ in masks)

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w in zip(b.column(0).to_pylist(), b.column(1)):
                words = np.array(w.as_py(), dtype=np.int64).view(np.uint64)
                for n, (m, length) in enumerate(masks):
                    if length != (len(words) if len(words) < SPAN else 0):
                        continue
                    h = _window_hashes(words, m, n).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(h), pa.int64()), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)],
                        ["number", "place", "hash"],
                    )

    seeds = keep(items.select("number", "words").mapInArrow(seeds_of, "number bigint, place int, hash bigint"), "seeds")
    n = seeds.count()
    bits = int(min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << int(np.ceil(np.log2(256 * max(1, n)))))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(bits, dtype=bool)
        for b in batches:
            for at in _places(b.column(0).to_numpy().view(np.uint64), bits):
                got[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(got).tobytes()], pa.binary())], ["bits"])

    parts = seeds.select("hash").coalesce(2).mapInArrow(fill, "bits binary").toLocalIterator()  # 64 MB each at the most
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts:
        packed |= np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(packed.tobytes())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)

        def known(h: np.ndarray) -> np.ndarray:
            left = np.arange(len(h))
            for at in _places(h, bits):
                at = at[left]
                left = left[(table[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
            return left

        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            out = {"doc": [], "words": [], "from": [], "place": [], "hash": []}
            for doc, words in zip(b.column(0).to_pylist(), _many(texts)):
                place, hashes = [], []
                for n, (m, _) in enumerate(masks):
                    h = _window_hashes(words, m, n)
                    hit = known(h)
                    place.append(hit)
                    hashes.append(h[hit])
                place, hashes = np.concatenate(place), np.concatenate(hashes)
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, hashes = place[order], hashes[order]
                # hits whose surroundings touch share one stretch of words
                cut = np.flatnonzero(np.diff(place) > 2 * reach) + 1
                for p, h in zip(np.split(place, cut), np.split(hashes, cut)):
                    low, high = max(0, int(p[0]) - reach), int(p[-1]) + widest + reach
                    out["doc"].append(doc)
                    out["words"].append(words[low:high].view(np.int64))
                    out["from"].append(low)
                    out["place"].append((p - low).astype(np.int32))
                    out["hash"].append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(out["doc"], pa.int64()), pa.array(out["words"], pa.list_(pa.int64())), pa.array(out["from"], pa.int64()),
                pa.array(out["place"], pa.list_(pa.int32())), pa.array(out["hash"], pa.list_(pa.int64())),
            ], ["doc", "words", "low", "place", "hash"])

    found = keep(docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(
        search, "doc bigint, words array<bigint>, low bigint, place array<int>, hash array<bigint>"
    ).withColumn("stretch", F.monotonically_increasing_id()), "hits")
    hits = found.select("stretch", F.explode(F.arrays_zip("place", "hash")).alias("h")).select("stretch", "h.place", "h.hash")
    pairs = hits.join(seeds.withColumnRenamed("place", "at"), "hash").select(
        "stretch", "number", (F.col("place") - F.col("at")).alias("shift")
    ).distinct()
    lined = pairs.groupBy("stretch", "number").agg(F.collect_set("shift").alias("shifts"))  # no more shifts than words in the stretch
    texts = found.select("stretch", "doc", "words")
    both = lined.join(texts, "stretch").join(items.select("number", "item", F.col("words").alias("test")), "number")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_, items_, matched, spans = [], [], [], []
            for doc, i, shifts, words, test in zip(*(b.column(c).to_pylist() for c in ("doc", "item", "shifts", "words", "test"))):
                best = max((overlap(words, test, s, span, share) for s in shifts), key=lambda x: (x[1], x[0]))
                if best[1]:
                    docs_.append(doc)
                    items_.append(i)
                    matched.append(best[0])
                    spans.append(best[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_, pa.int64()), pa.array(items_, pa.int64()), pa.array(matched, pa.int32()), pa.array(spans, pa.int32())],
                ["doc", "item", "matched", "span"],
            )

    proven = both.select("doc", "item", "shifts", "words", "test").mapInArrow(verify, "doc bigint, item bigint, matched int, span int")
    best = proven.groupBy("doc", "item").agg(F.max(F.struct("span", "matched")).alias("m"))
    return best.select(F.col("doc").alias(key), F.col("item").alias("item_id"), "m.matched", "m.span")


def overlap(words: list[int], test: list[int], shift: int, span: int, share: float) -> tuple[int, int]:
    """(matched, length) of the longest stretch in one alignment that agrees in ``share`` of its words; (0, 0) if none is long enough.

    ``shift`` is the place in ``words`` where ``test`` would begin. What is returned begins and ends with equal words; it may be
    shorter than ``span`` if only a stretch with other words at its ends is long enough.
    """
    low, high = max(0, -shift), min(len(test), len(words) - shift)
    if high <= low:
        return 0, 0
    same = np.array(test[low:high]) == np.array(words[low + shift: high + shift])
    need = min(span, len(test))
    hit = np.flatnonzero(same)
    # longest stretch whose sum of (same - share) is not negative, between two hits
    gain = np.cumsum(same - share)
    before = np.concatenate(([0.0], gain[:-1]))[hit]
    lowest = np.minimum.accumulate(before)
    best = (0, 0)
    for e, j in zip(hit[::-1], range(len(hit) - 1, -1, -1)):
        if e + 1 < max(need, best[1] + 1):
            break
        k = int(np.searchsorted(-lowest[: j + 1], -(gain[e] + 1e-9)))
        if k <= j:
            size = int(e - hit[k] + 1)
            if size >= need and size > best[1]:
                best = (int(same[hit[k]: e + 1].sum()), size)
    if best[1] or len(same) < need or not len(hit):
        return best
    total = np.concatenate(([0.0], gain))
    first = np.searchsorted(-np.minimum.accumulate(total), -(total + 1e-9))
    end = int(np.argmax(np.arange(len(total)) - first))
    inside = hit[(hit >= first[end]) & (hit < end)]
    if end - first[end] < need or not len(inside):
        return best
    return len(inside), int(inside[-1] - inside[0] + 1)


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key has no leak (rows that share a key share the verdict); columns as given."""
    bad = leaks(docs, benchmark, key, text).select(F.col(key).alias("leaky")).distinct()
    return docs.join(bad, docs[key].cast("bigint").eqNullSafe(F.col("leaky")), "left_anti")


def keep_clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that have no leak themselves, whatever their keys are; columns as given."""
    whole = placed(docs)
    with scratch(), text_batches(docs.sparkSession):
        found = leaks(whole.select("place", F.col("row")[text].alias("text")), benchmark, "place")
        bad = outlive(keep(found.select("place").distinct(), "leaking"))
    return whole.join(bad, "place", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
