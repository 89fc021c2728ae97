"""SimHash near-duplicates, joined by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common value at most half of it from each. So
every fingerprint stands for all its variants within half the radius, variants are brought together,
and fingerprints that share one are linked. The shuffle key is a linear hash of the variant: the 64 bit
positions are dealt to ``b`` blocks, and a value hashes to the parities of its blocks. The hash of
``x ^ mask`` is then the hash of ``x`` with that of ``mask``, so a task sends ``x`` once to each bucket
that a variant of it falls into, and the receiver rebuilds those variants. A mask of ``r`` bits turns at
most ``r`` parities, so of the ``2**b`` buckets only ``1 + b + b(b-1)/2`` (radius 4) are sent to: 37
of 256, 137 of 65,536. Inside a bucket a second hash cuts the variants into passes of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from chromaspark.llm.common import keep
from chromaspark.llm.components import components

SEED = 42
BITS = 64
BLOCK = 1 << 14  # fingerprints that a task deals to the buckets at a time
LEAST_BLOCKS, MOST_BLOCKS = 7, 32  # with 32 blocks, 8e12 fingerprints are a million a bucket
BUCKET_HELD = 1_000_000  # fingerprints that one bucket receives
PASS_VARIANTS = 1_000_000  # variants that one pass over a bucket holds in memory

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_PIECE = 1 << 20


def _word_runs(data: bytes, k: int) -> Iterator[list[bytes]]:
    """Words of a text, a megabyte at a time; a run repeats the last ``k - 1`` words of the one before."""
    tail: list[bytes] = []
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > _PIECE:
            cut = _SPACE.search(data, at + _PIECE)
            end = cut.start() if cut else end
        words = tail + data[at:end].split()
        yield words
        tail = words[max(0, len(words) - k + 1):] if k > 1 else []
        at = end


def fingerprint(text: str | None, k: int = 4) -> int:
    """SimHash of one text: a bit is set if more than half of the shingle hashes have it."""
    data = (text or "").encode().translate(_LOWER)
    hash_of, ones, total, last = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), 0, []
    for words in _word_runs(data, k):
        last = words
        if len(words) < k:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
        h = np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1:].tolist())), np.uint64, len(starts))
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
        total += len(h)
    if total == 0:
        return hash_of(b" ".join(last), SEED) if last else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(text, k: int = 4):
    """Column of fingerprints (bigint, the unsigned value's bits) of a text column; null or wordless text gives 0."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        got = np.fromiter((fingerprint(t.as_py(), k) for t in texts), np.uint64, len(texts))
        return pa.array(got.view(np.int64))

    return simhash(text)


def _masks(reach: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for n in range(reach + 1) for c in combinations(range(BITS), n)], dtype=np.uint64)


def block_count(n: int, reach: int) -> int:
    """Blocks of bit positions with which no bucket gets more than ``BUCKET_HELD`` of ``n`` fingerprints on average."""
    for blocks in range(LEAST_BLOCKS, MOST_BLOCKS):
        if n * sum(comb(blocks, i) for i in range(reach + 1)) <= BUCKET_HELD << blocks:
            return blocks
    return MOST_BLOCKS


class _Ball:
    """The variants within ``reach`` bits, dealt over ``2**blocks`` buckets, each cut into ``2**passes`` passes.

    The code of a value has the number of its bucket in the low bits and that of its pass above.
    """

    def __init__(self, reach: int, blocks: int, passes: int = 0):
        self.blocks = blocks
        inner = np.random.default_rng(64).integers(0, 1 << 32, BITS, dtype=np.uint64) & np.uint64((1 << passes) - 1)
        bits = (np.uint64(1) << (np.arange(BITS, dtype=np.uint64) % np.uint64(blocks))) | (inner << np.uint64(blocks))
        self.table = np.zeros((8, 256), dtype=np.uint64)
        for byte in range(8):
            for b in range(8):
                has = (np.arange(256) >> b) & 1 == 1
                self.table[byte, has] ^= bits[8 * byte + b]
        masks = _masks(reach)
        codes = self.code(masks)
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.groups = dict(zip(self.codes.tolist(), np.split(masks[order], first[1:])))

    def code(self, x: np.ndarray) -> np.ndarray:
        parts = np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)
        out = np.zeros(len(parts), dtype=np.uint64)
        for byte in range(8):
            out ^= self.table[byte][parts[:, byte]]
        return out

    def send(self, x: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, fingerprints with a variant there) for a block of fingerprints."""
        to = (self.code(x)[:, None] ^ self.codes[None, :]).ravel()
        order = np.argsort(to, kind="stable")
        to, owner = to[order], np.repeat(x, len(self.codes))[order]
        bucket, first = np.unique(to, return_index=True)
        for b, part in zip(bucket.tolist(), np.split(owner, first[1:])):
            yield b, part.tobytes()

    def dealt(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Indexes of the fingerprints of each code."""
        codes = self.code(x)
        order = np.argsort(codes, kind="stable").astype(np.uint32)
        value, first = np.unique(codes[order], return_index=True)
        return list(zip(value.tolist(), np.split(order, first[1:])))

    def size(self, bucket: int, x: np.ndarray) -> int:
        """Number of variants of ``x`` inside the bucket."""
        return sum(len(at) * len(self.groups.get(c ^ bucket, ())) for c, at in self.dealt(x))

    def variants(self, code: int, x: np.ndarray, dealt: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Variants of ``x`` that have the code, and the index of the fingerprint each belongs to."""
        found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for c, at in dealt:
            masks = self.groups.get(c ^ code)
            if masks is not None:
                found.append((x[at][:, None] ^ masks[None, :]).ravel())
                owners.append(np.repeat(at, len(masks)))
        return np.concatenate(found), np.concatenate(owners)


@lru_cache(maxsize=8)
def _ball(reach: int, blocks: int, passes: int = 0) -> _Ball:
    """A task meets many buckets and deals all of them in the same way."""
    return _Ball(reach, blocks, passes)


def _stars(v: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Edges (lowest, other) of the fingerprints ``who`` that share a variant ``v``."""
    s = np.sort(v)
    shared = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(shared):
        return np.zeros((0, 2), np.uint64)
    at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
    hit = shared[at] == v
    run, who = at[hit], who[hit]
    order = np.lexsort((who, run))
    run, who = run[order], who[order]
    head = np.concatenate(([True], run[1:] != run[:-1]))
    low = who[np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))]
    return np.unique(np.stack((low, who), axis=1)[~head], axis=0)


def bucket_links(bucket: int, x: np.ndarray, reach: int, blocks: int) -> Iterator[np.ndarray]:
    """Star edges of the fingerprints that share a variant of this bucket, pass after pass."""
    size, passes = _ball(reach, blocks).size(bucket, x), 0
    while size > PASS_VARIANTS << passes:
        passes += 1
    ball = _ball(reach, blocks, passes)
    dealt = ball.dealt(x)
    for inner in range(1 << passes):
        v, owner = ball.variants(bucket | inner << blocks, x, dealt)
        yield _stars(v, x[owner])


def linked_pairs(distinct: DataFrame, radius: int = 4, count: int | None = None) -> DataFrame:
    """Star edges ``(a, b)`` that connect all fingerprints at most ``radius`` (even) bits apart.

    ``distinct`` has one bigint column of distinct fingerprints. Fingerprints that share a variant are
    all within the radius of each other, so tying them to the lowest one loses no connection, and no
    list of all pairs is made. The number of buckets follows the number of fingerprints. A fingerprint is
    sent to ``1 + b + b(b-1)/2`` of ``2**b`` buckets at radius 4: 29 (232 bytes) up to 4 million
    fingerprints, 56 (448 bytes) up to 18 million, 121 (968 bytes) up to 270 million.
    """
    if radius % 2 or not 0 <= radius <= 6:
        raise ValueError("radius must be 0, 2, 4 or 6")
    reach = radius // 2
    blocks = block_count(distinct.count() if count is None else count, reach)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _ball(reach, blocks)

        def rows(x: np.ndarray) -> pa.RecordBatch:
            sent = list(ball.send(x))
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in sent], pa.int64()), pa.array([p for _, p in sent], pa.binary())], ["bucket", "packed"]
            )

        held = np.zeros(0, np.uint64)
        for b in batches:
            held = np.concatenate((held, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            while len(held) >= BLOCK:
                yield rows(held[:BLOCK])
                held = held[BLOCK:]
        if len(held):
            yield rows(held)

    def meet(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        x = np.unique(np.concatenate([np.frombuffer(p.as_py(), np.uint64) for p in group.column("packed")]))
        edges = np.unique(np.concatenate(list(bucket_links(bucket, x, reach, blocks))), axis=0).view(np.int64)
        return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})

    sent = distinct.mapInArrow(emit, "bucket bigint, packed binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """``(key, fingerprint, component_id)`` for each row of ``docs``.

    ``fingerprint`` is the 64-bit SimHash of ``k``-word shingles as 16 hex digits, ``component_id`` the
    smallest key that can be reached over fingerprints at most ``radius`` bits apart. Null and wordless
    texts have the fingerprint zero. Null keys are never the smallest unless a component has no other.
    Repeated rows are returned as often as given; an empty table gives an empty result; other columns
    are not looked at, whatever they are called.
    """
    marked = keep(docs.select(F.col(key).alias("id"), fingerprints(F.col(text), k).alias("fp")), "fingerprints")
    out = assign(marked, radius)
    return out.select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def assign(marked: DataFrame, radius: int = 4) -> DataFrame:
    """Add ``least``, the smallest ``id`` of each row's component, to a kept table ``(id, fp, ...)``."""
    first = keep(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    stars = components(linked_pairs(first.select("fp"), radius, first.count()))
    nodes = stars.select(F.col("u").alias("fp"), "v").union(stars.select("v", "v").distinct())
    reached = nodes.join(first, "fp")
    lowest = reached.groupBy("v").agg(F.min("least").alias("lowest"))
    moved = reached.join(lowest, "v").select("fp", "lowest")
    of_each = keep(first.join(moved, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("least")), "components")
    # both sides are plain scans now, so Spark can split the many rows of one fingerprint
    return marked.join(of_each, "fp")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest key stays.

    Exactly one row of a component stays, also among rows that share a key. Columns are those of ``docs``.
    """
    columns = docs.columns
    spark = docs.sparkSession
    whole = keep(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(key).alias("key"),
        fingerprints(F.col(text), k).alias("fp"), F.monotonically_increasing_id().alias("place"),
    ), "marked")
    # the id is a pair: rows without a key come last, rows with equal keys are told apart by place
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("place").alias("place"))
    placed = assign(whole.select("fp", "place", order.alias("id")), radius)
    extra = placed.where("place <> least.place").select("place")
    left = whole.join(extra, "place", "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in columns]) if columns else spark.createDataFrame([], docs.schema)
