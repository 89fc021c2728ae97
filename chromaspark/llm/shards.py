"""Sharding by a two-pass external shuffle, in DataFrame operations.

Pass one scatters the rows over buckets of a bounded size by a seeded hash. Pass two takes a bucket at
a time into memory, puts its rows into a Fisher-Yates order (Spark's ``shuffle``) and writes them.
Dealing the rows of that order out in turn gives shards whose row counts differ by one at the most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chromaspark.llm.common import drop_kept, keep, new_folder

BUCKET_BYTES = 16 << 20
BUCKET_ROWS = 100_000
HOT_PART = 4  # a row whose copies fill more than this part of a bucket is scattered copy by copy
MAX_BROADCAST_HOT = 1_000_000  # about 16 MB
SPREAD = 16
MAX_BROADCAST_BUCKETS = 1_000_000  # about 16 MB
GROUP = 1024  # buckets whose counts one task adds up


def _bucket_offsets(written: DataFrame) -> DataFrame:
    """``(bucket, before)``: rows in all lower buckets; sums in two levels, so that no task sees all buckets of a large table."""
    counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("bucket") / GROUP))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("m"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = counts.select("block", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("own"))
    return own.join(blocks, "block").select("bucket", (F.col("own") + F.col("base")).alias("before"))


def write_shards(
    docs: DataFrame, shards: int = 16, seed: int = 6, folder: str | None = None, key: str = "doc_id", text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> str:
    """Shuffle ``docs`` and write them as ``folder/shards/shard=K``; returns the folder (default: a new shared one).

    A written row has ``shard``, ``slot`` (gapless from 0 in a shard, the order in which to read it),
    ``size`` (bytes of the text in UTF-8, null: none, plus 1) and ``row``, a struct of all columns of
    ``docs``, so extra columns may have any name. Row counts of shards differ by one at the most. The
    order depends on the seed, keys and texts and, only among rows that are repeated very often, on where
    they stand. Null keys and texts, repeated rows and rows larger than a bucket are ordinary rows; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    columns = docs.columns
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + 1
    mix = F.xxhash64(F.lit(seed), F.col(key).isNull(), F.col(key), F.col(text).isNull(), F.col(text))
    total = docs.select(size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    n = total["n"]
    buckets = max(1, -(-(total["bytes"] or 0) // bucket_bytes), -(-n // BUCKET_ROWS))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), size.alias("size"), mix.alias("mix"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())  # of the scan, so a task done again gives the same
    same = docs.select(mix.alias("mix"), size.alias("size")).groupBy("mix").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes"))
    hot = keep(same.where((F.col("copies") > 1) & (
        (F.col("bytes") > bucket_bytes // HOT_PART) | (F.col("copies") > BUCKET_ROWS // HOT_PART)
    )).select("mix", F.lit(True).alias("hot")), "hot")
    scattered = hot.count()
    salt = F.when(F.col("hot"), F.col("place")).otherwise(F.lit(0))
    if scattered > MAX_BROADCAST_HOT:  # every hot row meets its copies in several tasks
        rows = rows.withColumn("part", F.pmod("place", F.lit(SPREAD).cast("bigint")))
        hot = hot.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>")))
        rows = rows.join(hot, ["mix", "part"], "left")
    else:
        rows = rows.join(F.broadcast(hot), "mix", "left")
    rows = rows.select(
        "row", "size", "mix", F.pmod(F.xxhash64(F.lit(seed), "mix", salt), F.lit(buckets)).cast("int").alias("bucket")
    )

    def by_mix(a, b):
        return F.when(a["mix"] < b["mix"], -1).when(a["mix"] > b["mix"], 1).otherwise(0)

    packed = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(
        F.collect_list(F.struct("row", "size", "mix")).alias("rows")
    )
    # a bucket is a partition of its own, so the seeded shuffle does not depend on the cluster
    mixed = packed.select("bucket", F.shuffle(F.array_sort("rows", by_mix), seed).alias("rows"))
    laid = mixed.select("bucket", F.posexplode("rows").alias("pos", "r")).select("bucket", "pos", "r.row", "r.size")
    laid.write.option("compression", "zstd").parquet(f"{folder}/buckets")
    drop_kept(hot)

    written = spark.read.schema(laid.schema).parquet(f"{folder}/buckets")
    before = _bucket_offsets(written)
    if buckets <= MAX_BROADCAST_BUCKETS:  # one short row for each
        before = F.broadcast(before)
    place = F.col("before") + F.col("pos")
    dealt = written.join(before, "bucket").select(
        "row", "size", F.floor(place / shards).cast("bigint").alias("slot"), F.pmod(place, F.lit(shards)).cast("int").alias("shard")
    )
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(f"{folder}/shards")
    return folder


def read_shards(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of the shard files; ``schema`` is that of the documents written."""
    from pyspark.sql import types as T

    whole = T.StructType([
        T.StructField("row", schema), T.StructField("size", T.LongType()), T.StructField("slot", T.LongType()),
        T.StructField("shard", T.IntegerType()),
    ])
    return spark.read.schema(whole).parquet(f"{folder}/shards")
