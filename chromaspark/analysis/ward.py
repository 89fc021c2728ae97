"""Ward clustering by rounds of mutual nearest clusters.

Ward's merge cost is reducible, so merging every pair of clusters that are each other's nearest gives
the same tree as merging one closest pair at a time (Murtagh, 1983). Each round is an exact
nearest-cluster search and an equi-join; identical feature vectors start as one weighted cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from chromaspark.functions.columns import col, features_as
from chromaspark.functions.nearest import nearest, pair_hash
from chromaspark.functions.reuse import cut_lineage, keep
from chromaspark.operators.lookup import lookup_join
from chromaspark.operators.neighbours import as_vectors, distinct_vectors
from chromaspark.schema import RUN_ID, quoted

MERGES = "left bigint, right bigint, height double, size double, round int"
TAIL = 256


@dataclass
class WardTree:
    """Merges of distinct vectors plus the vector of each run.

    ``merges`` has (left, right, height, size, round): cluster ``right`` joins cluster ``left``, whose
    id lives on. A cluster's id is its smallest run key. ``leaves`` maps features to the vector id.
    """

    features: list[str]
    leaves: DataFrame
    merges: DataFrame


def _finish(clusters: pd.DataFrame) -> pd.DataFrame:
    """Merge the last few clusters (at most ``TAIL``) by the same mutual-nearest rule."""
    ids = clusters["id"].to_numpy(dtype=np.int64)
    x, w = np.stack(clusters["v"].to_numpy()).astype(np.float64), clusters["w"].to_numpy(dtype=np.float64)
    out = []
    while len(ids) > 1:
        d2 = np.zeros((len(ids), len(ids)))
        for j in range(x.shape[1]):
            d2 += (x[:, j][:, None] - x[:, j][None, :]) ** 2
        d2 = np.round(d2 * (2 * w[:, None] * w[None, :] / (w[:, None] + w[None, :])), 9)
        np.fill_diagonal(d2, np.inf)
        tie = pair_hash(np.repeat(ids, len(ids)), np.tile(ids, len(ids))).reshape(d2.shape)
        low = d2.min(axis=1, keepdims=True)
        near = np.where(d2 == low, tie, np.iinfo(np.int64).max).argmin(axis=1)
        a = np.flatnonzero((near[near] == np.arange(len(ids))) & (ids < ids[near]))
        b = near[a]
        size = w[a] + w[b]
        out.append(pd.DataFrame({"left": ids[a], "right": ids[b], "height": np.sqrt(d2[a, b]), "size": size}))
        x[a] = (x[a] * w[a][:, None] + x[b] * w[b][:, None]) / size[:, None]
        w[a] = size
        stay = np.setdiff1d(np.arange(len(ids)), b)
        ids, x, w = ids[stay], x[stay], w[stay]
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["left", "right", "height", "size"])


def ward_tree(df: DataFrame, features: list[str], key: str = RUN_ID, tail: int = TAIL, cell_rows: int = 4096) -> WardTree:
    """Full merge tree of the distinct feature vectors, weighted by how many runs share them."""
    leaves = cut_lineage(distinct_vectors(df, features, key))
    return WardTree(list(features), leaves, ward_merges(as_vectors(leaves, None, features), tail, cell_rows))


def ward_merges(vectors: DataFrame, tail: int = TAIL, cell_rows: int = 4096) -> DataFrame:
    """Merges of ``(id, v, w)`` rows. ``tail`` bounds what one task may finish on its own."""
    spark = vectors.sparkSession
    clusters = cut_lineage(vectors.select("id", "v", "w"))
    rounds, n, r = [], clusters.count(), 0
    while n > max(tail, 1):
        near = keep(nearest(clusters, clusters, 1, exclude_self=True, ward=True, cell_rows=cell_rows))
        back = near.select(F.col("qid").alias("tid"), F.col("tid").alias("qid"))
        mutual = near.join(back, ["qid", "tid"]).where(F.col("qid") < F.col("tid"))
        a, b = clusters.alias("a"), clusters.alias("b")
        pairs = mutual.join(a, F.col("qid") == F.col("a.id")).join(b, F.col("tid") == F.col("b.id"))
        size = F.col("a.w") + F.col("b.w")
        center = F.zip_with("a.v", "b.v", lambda p, q: (p * F.col("a.w") + q * F.col("b.w")) / size)
        merged = cut_lineage(pairs.select(
            F.col("qid").alias("left"), F.col("tid").alias("right"), F.sqrt("d2").alias("height"),
            size.alias("size"), center.alias("v"), F.lit(r).alias("round"),
        ))
        gone = merged.select(F.explode(F.array("left", "right")).alias("id"))
        clusters = cut_lineage(clusters.join(gone, "id", "left_anti").unionByName(
            merged.select(F.col("left").alias("id"), "v", F.col("size").alias("w"))))
        done = merged.count()
        if done == 0:
            raise RuntimeError("no mutual nearest pair found")
        rounds.append(merged.drop("v"))
        n -= done
        r += 1
    if n > 1:
        last = clusters.coalesce(1).mapInPandas(_finish_all, "left bigint, right bigint, height double, size double")
        rounds.append(last.withColumn("round", F.lit(r)))
    out = spark.createDataFrame([], MERGES)
    for part in rounds:
        out = out.unionByName(part.select("left", "right", "height", "size", "round"))
    return cut_lineage(out)


def _finish_all(batches):
    parts = [b for b in batches if len(b)]
    if parts:
        yield _finish(pd.concat(parts, ignore_index=True))


def numbered_merges(tree: WardTree, pieces: int = 256) -> DataFrame:
    """``(step, left, right, height, size)`` with steps in order of height, from 0.

    Heights are cut into ranges at approximate quantiles; ranks are formed inside a range and moved
    by the range's offset, so the order never sits in one task.
    """
    m = tree.merges
    cuts = m.agg(F.percentile_approx("height", [i / pieces for i in range(1, pieces)], 1000).alias("c")).first()["c"]
    edges = sorted(set(cuts or []))
    piece = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda c: c < F.col("height"))) if edges else F.lit(0)
    placed = m.withColumn("_p", piece)
    w = W.partitionBy("_p").orderBy("height", "round", "left")
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # at most ``pieces`` rows
    offsets = counts.select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    return placed.withColumn("_r", F.row_number().over(w)).join(F.broadcast(offsets), "_p").select(
        (F.col("o") + F.col("_r") - 1).alias("step"), "left", "right", "height", "size"
    )


def ward_labels(tree: WardTree, df: DataFrame, k: int = 2, key: str = RUN_ID) -> DataFrame:
    """``(key, cluster)`` after cutting the last ``k - 1`` merges; clusters numbered by smallest run key.

    Leaves find their cluster by pointer doubling over the remaining merges.
    """
    top = tree.merges.orderBy(F.col("height").desc(), F.col("round").desc(), F.col("left").desc()).limit(k - 1)
    cut = top.select("right").withColumn("_cut", F.lit(1))  # k - 1 rows
    link = tree.merges.join(F.broadcast(cut), "right", "left").where("_cut IS NULL").select(
        F.col("right").alias("id"), F.col("left").alias("up")
    )
    ids = tree.leaves.select("id")
    up = cut_lineage(ids.join(link, "id", "left").select("id", F.coalesce("up", "id").alias("up")))
    while True:
        nxt = up.select(F.col("id").alias("up"), F.col("up").alias("far"))
        hop = cut_lineage(up.join(nxt, "up").select("id", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")))
        moved = not hop.where("moved").isEmpty()
        up = hop.select("id", "up")
        if not moved:
            break
    roots = up.select("up").distinct()
    numbers = roots.withColumn("cluster", (F.row_number().over(W.orderBy("up")) - 1).cast("int"))  # k rows
    leaf = up.join(F.broadcast(numbers), "up").select("id", "cluster")
    alias = {f: f"_f{i}" for i, f in enumerate(tree.features)}
    named = keep(tree.leaves.join(leaf, "id").withColumnsRenamed(alias).select(*alias.values(), "cluster"))
    rows = df.selectExpr(quoted(key), *features_as(list(alias), list(alias.values())))
    return lookup_join(rows, named, list(alias.values()), "inner", spread=F.xxhash64(col(key))).select(col(key), "cluster")
