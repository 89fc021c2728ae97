"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chromaspark.llm.common import drop_kept, keep

MAX_ROUNDS = 200


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")
    ).first()
    return tuple(r)


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the lowest node of that neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's lower neighbours, and itself, are tied to the lowest of them."""
    low = _lowest(edges)
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)``: each node of ``edges`` (two bigint columns) that is not the lowest of its component, with that lowest node.

    Rows with a null end and loops are ignored, repeated edges count once; no edges give an empty
    table. A hot node never gathers its neighbours in one task: minima are pre-aggregated and the
    joins are plain equi-joins, which Spark splits where a key is skewed. The state of a round is a
    written table; the one before it is deleted.
    """
    a, b = edges.columns[:2]
    now = keep(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges"
    )
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            return now
        after = keep(_small_star(_large_star(now)), "edges")
        drop_kept(now)
        now, before, state = after, state, _state(after)
        if state == before:
            return now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
