"""Near-duplicates by the similarity of their word shingles: SimHash balls and MinHash bands find candidates, whole sets of shingles decide.

Two texts are linked if the Jaccard similarity of their sets of ``k``-word shingles is at least ``share``.
Texts with equal sets are taken together first. Texts meet if meet-in-the-middle ball hashing (:mod:`simhash`, with its
own shingles and radius) ties their fingerprints. That finds copies that are all but equal; for texts with more
edits, a sketch of ``BANDS`` x ``ROWS`` minima is cut into bands, and texts with an equal band meet, too. In each such bucket all are compared with the most central one; only
those that stay apart from it are then compared with all that met it, block by block, so a large group of copies costs as
many comparisons as it has rows. A band is eight minima, which texts far from similar hardly ever share, so few stay
apart; pairs whose sets differ too much in size are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from chromaspark.llm.common import BATCH_BYTES, keep, outlive, placed, scratch, text_batches
from chromaspark.llm.components import components
from chromaspark.llm.decontaminate import _BASE, _mix, _power_tables
from chromaspark.llm.simhash import _LOWER, _PIECE, _SPACE, fingerprint, linked_pairs

WORDS = 5
SHARE = 0.8
# a pair at similarity s shares no band with probability (1 - s**ROWS)**BANDS: 1.8e-6 at 0.8
BANDS, ROWS = 72, 8

BROADCAST_ROWS = 2_000_000
BLOCK_SHINGLES, BLOCK_SETS = 1 << 18, 512  # of one block, about
BLOCK_ROWS = 8  # pairs of blocks that a task holds at a time
_COLUMNS = 4096

_STEP = 256  # shingles that meet all hash functions at a time
_rng = np.random.default_rng(5)
_FACTOR = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_ASCII_SPACE = np.array([i == 0x20 or 0x09 <= i <= 0x0D for i in range(256)])


def _hash_words(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII spaces."""
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    space = _ASCII_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
        h = (total[end] - total[start]) * down[start]
    return _mix(h ^ (end - start).astype(np.uint64))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles (ASCII case does not matter); a shorter text is one shingle."""
    data = (text or "").encode().translate(_LOWER)
    parts, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > _PIECE:
            cut = _SPACE.search(data, at + _PIECE)
            end = cut.start() if cut else end
        parts.append(_hash_words(data[at:end]))
        at = end
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, min(k, len(words)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(words))):
            h = _mix(h * np.uint64(_BASE) + words[i: i + n])
    return np.unique(h)


def bands(found: np.ndarray) -> np.ndarray:
    """One hash for each band of the sketch of a set of shingles; none for the empty set."""
    if not len(found):
        return found
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        # the shingles are random numbers already, so a random linear map orders them anew
        short = (found >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), _STEP):
            x = short[None, at: at + _STEP] * _FACTOR
            x += _SHIFT
            np.minimum(low, x.min(axis=1), out=low)
        h = np.arange(1, BANDS + 1, dtype=np.uint64)  # bands of different places never meet
        for column in low.astype(np.uint64).reshape(BANDS, ROWS).T:
            h = _mix(h * np.uint64(_BASE) + column)
    return h


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _marked(docs: DataFrame, text: str, k: int) -> DataFrame:
    """``(place, key, content, n, fp, bands)`` of ``(row, key, place)``: ``content`` is shared by equal sets of ``n`` shingles only."""

    @F.arrow_udf("struct<content: binary, n: int, fp: bigint, bands: array<bigint>>")
    def mark(texts: pa.Array) -> pa.Array:
        contents, sizes, prints, keys = [], [], np.zeros(len(texts), np.uint64), []
        for i, t in enumerate(texts):
            t = t.as_py()
            found = shingles(t, k)
            contents.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            prints[i] = fingerprint(t)
            keys.append(bands(found).view(np.int64))
        return pa.StructArray.from_arrays(
            [pa.array(contents, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
            ["content", "n", "fp", "bands"],
        )

    return docs.select("place", "key", mark(F.col("row")[text]).alias("mark")).select("place", "key", "mark.*")


def _tied(prints: DataFrame) -> DataFrame:
    """``(place, n, band)`` of the distinct ``(place, n, fp)``: texts share a bucket with the lowest fingerprint that theirs is tied to."""
    stars = keep(linked_pairs(keep(prints.select("fp").distinct(), "distinct")), "stars")
    to = prints.join(stars.select(F.col("a").alias("to"), F.col("b").alias("fp")), "fp").select("place", "n", "to")
    every = prints.select("place", "n", F.col("fp").alias("to")).union(to)
    return every.select("place", "n", F.xxhash64("to", F.lit("ball")).alias("band")).distinct()


def _sets(texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(place, found)``: the shingles of the texts whose place is in the kept table ``asked``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, size, since = [], 0, 0
            for i, t in enumerate(b.column(1), 1):
                found.append(shingles(t.as_py(), k).view(np.int64))
                size += found[-1].nbytes
                if size >= BATCH_BYTES or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(since, i - since), pa.array(found, pa.list_(pa.int64()))], ["place", "found"])
                    found, size, since = [], 0, i

    few = asked.count() <= BROADCAST_ROWS  # 8 bytes each: the texts need not move
    return texts.join(F.broadcast(asked) if few else asked, "place", "left_semi").mapInArrow(cut, "place bigint, found array<bigint>")


def _kept_sets(texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    with text_batches(texts.sparkSession):
        return keep(_sets(texts, asked, k), "sets")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, share: float) -> DataFrame:
    """Those of the distinct ``pairs`` (kept table of places ``a`` < ``b``) whose texts are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [[x.values.to_numpy().view(np.uint64) for x in b.column(c)] for c in (2, 3)]
            yes = pa.array([similarity(x, y) >= share for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(yes)

    asked = keep(pairs.select(F.col("a").alias("place")).union(pairs.select("b")).distinct(), "asked")
    sets = _kept_sets(texts, asked, k)
    first = pairs.join(sets.select(F.col("place").alias("a"), F.col("found").alias("x")), "a")
    both = first.join(sets.select(F.col("place").alias("b"), F.col("found").alias("y")), "b")
    with text_batches(texts.sparkSession):  # two sets a row
        return keep(both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), "links")


def _blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``(low, places, roots, ends, found)``: the sets of ``(low, place, n, root)`` packed into blocks of bounded size within each ``low``."""
    sizes = rows.groupBy("low").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).alias("blocks"))
    dealt = rows.join(sizes, "low").withColumn("block", F.pmod(F.xxhash64("place"), "blocks")).join(sets, "place")
    packed = dealt.groupBy("low", "block").agg(F.collect_list(F.struct("place", "root", "found")).alias("t"))
    return packed.select("low", F.col("t.place").alias("places"), F.col("t.root").alias("roots"),
                         F.transform("t.found", F.size).alias("sizes"), F.flatten("t.found").alias("found"))


def overlaps(x: np.ndarray, x_sizes: np.ndarray, y: np.ndarray, y_sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each set of one block with each of another (elements one set after the other)."""
    common = np.intersect1d(x, y)
    out = np.zeros((len(x_sizes), len(y_sizes)), dtype=np.float32)
    for at in range(0, len(common), _COLUMNS):
        some = common[at: at + _COLUMNS]
        sides = []
        for values, sizes in ((x, x_sizes), (y, y_sizes)):
            place = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[place] == values
            side = np.zeros((len(sizes), len(some)), dtype=np.float32)
            side[np.repeat(np.arange(len(sizes)), sizes)[hit], place[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _linked_apart(tied: DataFrame, texts: DataFrame, k: int, share: float) -> DataFrame:
    """Links of rows of ``(low, place, n, root, low_root)`` that are not in ``low``'s component with others of the same ``low``.

    Of the links of one text with one component within a block a single one is returned.
    """
    apart = tied.where("root <> low_root")
    rows = keep(tied.join(apart.select("low").distinct(), "low", "left_semi"), "crowded")
    asked = keep(rows.select("place").distinct(), "asked")
    sets = _kept_sets(texts, asked, k)
    ask, given = (_blocks(r.select("low", "place", "n", "root"), sets) for r in (rows.where("root <> low_root"), rows))
    both = ask.join(given.select("low", *[F.col(c).alias(f"other_{c}") for c in given.columns[1:]]), "low")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c) for c in ("places", "roots", "sizes", "found", "other_places", "other_roots", "other_sizes", "other_found")]
            for row in range(b.num_rows):
                place, root, size, found, o_place, o_root, o_size, o_found = (c[row].values.to_numpy() for c in columns)
                met = overlaps(found, size, o_found, o_size)
                # the same quotient as for single pairs, so that both agree on ties
                alike = met.astype(np.float64) / np.maximum(1, size[:, None] + o_size[None, :] - met) >= share
                i, j = np.nonzero(alike & (root[:, None] != o_root[None, :]))
                if not len(i):
                    continue
                _, first = np.unique(np.stack((i, o_root[j])), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(place[i[first]]), pa.array(o_place[j[first]])], ["a", "b"])

    with text_batches(texts.sparkSession, BLOCK_ROWS):
        return keep(both.drop("low").mapInArrow(check, "a bigint, b bigint"), "links")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component of linked texts the row with the smallest key stays.

    Exactly one row of a component stays, also among rows that share a key; rows without a key stay only
    if their component has no other. Null and wordless texts have the same (empty) set. Columns are those of ``docs``.
    """
    whole = placed(docs)
    with scratch():
        texts = whole.select("place", F.col("row")[text].alias("text"))
        extra = outlive(keep(_extra(whole.withColumn("key", F.col("row")[key]), texts, text, k, share), "extra"))
    return whole.join(extra, "place", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _extra(whole: DataFrame, texts: DataFrame, text: str, k: int, share: float) -> DataFrame:
    """Places of the rows of ``(row, key, place)`` that do not stay."""
    with text_batches(whole.sparkSession):
        marked = keep(_marked(whole, text, k), "marked")
    # the id is a pair: rows without a key come last, rows with equal keys are told apart by place
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("place").alias("place"))
    first = keep(marked.select("content", order.alias("id")).groupBy("content").agg(F.min("id").alias("id")), "contents")
    # equal sets may have several fingerprints, as those count repeats
    prints = marked.select("content", "n", "fp").distinct().join(first.select("content", F.col("id.place").alias("place")), "content")
    balls = keep(_tied(keep(prints.select("place", "n", "fp"), "prints")), "balls")
    first = first.select("id", F.col("id.place").alias("place"))

    met = marked.join(first.select("place"), "place", "left_semi").select("place", "n", F.explode("bands").alias("band"))
    met = met.union(balls)
    size = met.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = keep(met.join(size, "band"), "met")  # buckets of two and more
    # the text in the most and largest buckets is the likeliest origin of the others, and so all of a bucket meet that one
    score = met.groupBy("place").agg(F.sum("size").alias("score"))
    ranked = keep(met.join(score, "place").drop("size"), "ranked")
    middle = ranked.groupBy("band").agg(F.max(F.struct("score", (-F.col("place")).alias("other"), "n")).alias("m"))
    middle = middle.select("band", (-F.col("m.other")).alias("low"), F.col("m.n").alias("low_n"))
    met = keep(ranked.drop("score").join(middle, "band"), "met")
    close = F.least("n", "low_n") >= share * F.greatest("n", "low_n")
    pairs = keep(met.where((F.col("place") != F.col("low")) & close).select(
        F.least("low", "place").alias("a"), F.greatest("low", "place").alias("b")
    ).distinct(), "pairs")
    links = _linked(pairs, texts, k, share)

    # who is not yet in the component of that text is compared with all that met it, in blocks
    of = components(links).withColumnRenamed("v", "root")
    roots = lambda name, to: of.select(F.col("u").alias(name), F.col("root").alias(to))
    tied = met.join(roots("place", "root"), "place", "left").join(roots("low", "low_root"), "low", "left")
    tied = keep(tied.select("low", "place", "n", F.coalesce("root", "place").alias("root"), F.coalesce("low_root", "low").alias("low_root")).distinct(), "tied")
    links = links.union(_linked_apart(tied, texts, k, share))

    of = components(links)
    members = of.select(F.col("u").alias("place"), "v").union(of.select("v", "v").distinct()).join(first, "place")
    lowest = members.groupBy("v").agg(F.min("id").alias("least"))
    copies = members.join(lowest, "v").where("place <> least.place").select("place")
    return copies.union(marked.join(first, "place", "left_anti").select("place"))
