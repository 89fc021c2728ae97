"""Deterministic random splits and folds.

A row's place is decided by a portable hash of ``seed:key``, never by partition or row order, so the
same table gives the same split under any partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chromaspark.functions.columns import col, hash32
from chromaspark.functions.reuse import collect_bounded, keep
from chromaspark.schema import RUN_ID

SEED = 42
FOLD_SEED = 43
_ALL, _HASH = "_all", "_split_hash"
_LEVELS = (20, 10, 0)  # hash bits left over after each narrowing step
SMALL_GROUP = 100_000


def hash_split(df: DataFrame, key: str = RUN_ID, seed: int = SEED, percent: int = 20) -> DataFrame:
    """Add ``is_test``: about ``percent`` of the rows, by hash. No shuffle."""
    return df.withColumn("is_test", (hash32(key, seed) % 100) < percent)


def class_quotas(counts: dict, test_size: float) -> dict:
    """Test rows per class: ceil of the total, shared by largest remainder (ties: smaller code)."""
    total = sum(counts.values())
    wanted = math.ceil(test_size * total - 1e-9)
    exact = {c: n * wanted / total for c, n in counts.items()}
    quota = {c: math.floor(x + 1e-9) for c, x in exact.items()}
    left = wanted - sum(quota.values())
    for c in sorted(counts, key=lambda c: (-(exact[c] - quota[c]), c))[:left]:
        quota[c] += 1
    return quota


def _cutoffs(rows: DataFrame, quota: dict) -> dict:
    """For each class the (hash, key) of its last test row, from ``(c, k, h)`` of a kept table.

    Radix selection: count rows per hash prefix, keep only the prefix the quota falls into, refine.
    Every step is one aggregation over at most 4,096 prefixes a class and hands one row a class to the
    driver; no class is ever sorted as a whole.
    """
    open_ = {c: (None, q) for c, q in quota.items() if q > 0}
    ready: dict = {}
    for level, shift in enumerate(_LEVELS):
        if not open_:
            break
        counts = _inside(rows, open_, _LEVELS[level - 1] if level else None).groupBy(
            "c", "need", F.shiftright("h", shift).alias("p")
        ).agg(F.count(F.lit(1)).alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("c").orderBy("p")))
        hit = upto.where("upto >= need AND upto - n < need").collect()  # one row a class
        narrowed = {r["c"]: (r["p"], r["need"] - (r["upto"] - r["n"]), r["n"]) for r in hit}
        small = {c: v for c, v in narrowed.items() if v[2] <= SMALL_GROUP or shift == 0}
        if small:
            order = F.row_number().over(W.partitionBy("c").orderBy("h", "k"))
            last = _inside(rows, {c: v[:2] for c, v in small.items()}, shift).withColumn("rn", order).where("rn = need")
            ready.update({r["c"]: (r["h"], r["k"]) for r in last.collect()})
        open_ = {c: v[:2] for c, v in narrowed.items() if c not in small}
    return ready


def _inside(rows: DataFrame, groups: dict, shift: int | None) -> DataFrame:
    """Rows of the given classes (at most 10,000, so broadcast), within each one's prefix if there is one, with its ``need``."""
    schema = StructType([StructField("_c", rows.schema["c"].dataType), StructField("_p", LongType()), StructField("need", LongType())])
    table = rows.sparkSession.createDataFrame([(c, p, need) for c, (p, need) in groups.items()], schema)
    same = F.col("c") == F.col("_c")
    if shift is not None:
        same = same & (F.shiftright("h", shift) == F.col("_p"))
    return rows.join(F.broadcast(table), same).drop("_c", "_p")


def exact_split(
    df: DataFrame, strata: str | None = None, key: str = RUN_ID, seed: int = SEED, test_size: float = 0.2
) -> DataFrame:
    """Add ``is_test`` for exactly ceil(test_size * n) rows: the lowest hashes, per class if given.

    Rows are kept with their hash, which is the dearest part. Row placement is a projection of that table against
    one cut-off per class; rows are not shuffled.
    """
    group = strata or _ALL
    base = keep(df.withColumn(_HASH, hash32(key, seed)))
    base = base if strata else base.withColumn(_ALL, F.lit(0))
    rows = collect_bounded(base.groupBy(col(group)).count(), 10_000, "classes of a split")
    counts = {r[0]: r[1] for r in rows if r[0] is not None}
    if not counts:
        return df.withColumn("is_test", F.lit(False))
    quota = class_quotas(counts, test_size)
    if strata and sum(quota.values()) < len(counts):
        raise ValueError("the test share is smaller than the number of classes")
    last = _cutoffs(base.select(col(group).alias("c"), col(key).alias("k"), F.col(_HASH).alias("h")), quota)
    schema = StructType([
        StructField("_cut_class", base.select(col(group)).schema[0].dataType), StructField("_cut_hash", LongType()),
        StructField("_cut_key", base.select(col(key)).schema[0].dataType),
    ])
    cuts = df.sparkSession.createDataFrame([(c, h, k) for c, (h, k) in last.items()], schema)  # one row a class
    h = F.col(_HASH)
    before = (h < F.col("_cut_hash")) | ((h == F.col("_cut_hash")) & (col(key) <= F.col("_cut_key")))
    joined = base.join(F.broadcast(cuts), col(group) == F.col("_cut_class"), "left")
    return joined.select(*[col(c) for c in df.columns], F.coalesce(before, F.lit(False)).alias("is_test"))


def stratified_split(df: DataFrame, strata: str, key: str = RUN_ID, seed: int = SEED, test_size: float = 0.2):
    return exact_split(df, strata, key, seed, test_size)


def hash_folds(df: DataFrame, folds: int = 3, key: str = RUN_ID, seed: int = FOLD_SEED) -> DataFrame:
    """Add ``fold`` in 0..folds-1 by hash."""
    return df.withColumn("fold", (hash32(key, seed) % folds).cast("int"))


def fold_count(smallest_class: int) -> int:
    """Number of stratified folds: 3, but not more than the smallest class, and at least 2."""
    return min(3, max(2, smallest_class))


def hash_rank(
    df: DataFrame, strata: str, key: str = RUN_ID, seed: int = FOLD_SEED, buckets_bits: int = 12, out: str = "rank"
) -> DataFrame:
    """Rank (from 1) of each row within its class in hash order.

    Counts per (class, hash prefix) give each prefix its offset; rows are ranked only inside a
    prefix, so the largest class is spread over 4,096 window groups instead of one.
    """
    shift = 32 - buckets_bits
    rows = df.withColumn("_h", hash32(key, seed)).withColumn("_b", F.shiftright("_h", shift))
    counts = rows.groupBy(col(strata), F.col("_b")).agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy(col(strata)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        col(strata), "_b", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(W.partitionBy(col(strata), F.col("_b")).orderBy("_h", col(key)))
    ranked = rows.withColumn("_in", inside).join(offsets, [strata, "_b"])
    return ranked.select(*[col(c) for c in df.columns], (F.col("_offset") + F.col("_in")).alias(out))


def stratified_folds(
    df: DataFrame, strata: str, folds: int = 3, key: str = RUN_ID, seed: int = FOLD_SEED
) -> DataFrame:
    """Add ``fold`` so that every class is dealt evenly over the folds, in hash order."""
    ranked = hash_rank(df, strata, key, seed, out="_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")
