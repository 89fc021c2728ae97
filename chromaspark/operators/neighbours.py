"""k-nearest-neighbour join over run tables.

Runs repeat the same conditions many times, so both sides are first reduced to distinct feature
vectors. Of each train vector only its ``k`` smallest keys can ever be among a query's neighbours
(ties go to the smaller key), which bounds what a heavily repeated vector contributes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from chromaspark.functions.columns import col, features_as, zero
from chromaspark.functions.nearest import nearest
from chromaspark.functions.reuse import keep
from chromaspark.operators.lookup import lookup_join
from chromaspark.operators.moments import Scaler, fit_scaler
from chromaspark.schema import RUN_ID, quoted


def distinct_vectors(df: DataFrame, features: list[str], key: str = RUN_ID) -> DataFrame:
    """One row per distinct zero-filled feature vector: the features, ``id`` (smallest key), ``w`` (rows)."""
    base = df.selectExpr(f"{quoted(key)} AS _k", *features_as(features))
    return base.groupBy(*features).agg(F.expr("min(_k) AS id"), F.expr("cast(count(1) AS double) AS w"))


def as_vectors(distinct: DataFrame, scaler: Scaler | None, features: list[str]) -> DataFrame:
    """``(id, v, w)`` with the (scaled) features as an array."""
    cells = scaler.texts() if scaler else [zero(f) for f in features]
    return distinct.selectExpr("id", f"array({', '.join(cells)}) AS v", "w")


def first_members(df: DataFrame, features: list[str], k: int, values: list[str], key: str = RUN_ID) -> DataFrame:
    """The ``k`` rows with the smallest key of each distinct vector, with the vector's ``id``.

    The rank filter is applied before the shuffle, so a hot vector sends at most k rows per task.
    """
    base = df.selectExpr(f"{quoted(key)} AS member", *features_as(features), *[quoted(v) for v in values])
    over = ", ".join(quoted(f) for f in features)
    top = base.selectExpr("*", f"row_number() OVER (PARTITION BY {over} ORDER BY member) AS rn").where(f"rn <= {int(k)}")
    return top.selectExpr(f"min(member) OVER (PARTITION BY {over}) AS tid", "member", *[quoted(v) for v in values])


@dataclass
class KnnIndex:
    """Fitted neighbour model: scaler, distinct train vectors and their first members."""

    features: list[str]
    scaler: Scaler
    k: int
    vectors: DataFrame
    members: DataFrame
    target: str | None = None

    def vector_neighbours(self, queries: DataFrame) -> DataFrame:
        """Neighbour rows ``(qid, rank, member, d2, <target>)`` of query vectors ``(id, v, w)``."""
        close = nearest(queries, self.vectors, self.k)
        rows = close.join(self.members, "tid")
        rank = "row_number() OVER (PARTITION BY qid ORDER BY d2, member) AS rank"
        return rows.selectExpr("*", rank).where(f"rank <= {int(self.k)}").drop("tid")


def fit_knn(
    train: DataFrame, features: list[str], k: int, target: str | None = None, key: str = RUN_ID,
    scaler: Scaler | None = None,
) -> KnnIndex:
    scaler = scaler or fit_scaler(train, features)
    vectors = keep(as_vectors(distinct_vectors(train, features, key), scaler, features))
    members = keep(first_members(train, features, k, [target] if target else [], key))
    return KnnIndex(list(features), scaler, k, vectors, members, target)


def knn_join(
    query: DataFrame, train: DataFrame, features: list[str], k: int, key: str = RUN_ID,
    exclude_self: bool = False,
) -> DataFrame:
    """The ``k`` nearest train rows of every query row: ``(key, rank, neighbour, distance)``.

    Euclidean on features scaled by the train side. ``exclude_self`` drops a row as its own neighbour.
    """
    take = k + 1 if exclude_self else k
    index = fit_knn(train, features, take, key=key)
    asked = keep(distinct_vectors(query, features, key))
    near = index.vector_neighbours(as_vectors(asked, index.scaler, features))
    packed = near.groupBy("qid").agg(  # at most k entries per query vector
        F.array_sort(F.collect_list(F.struct("d2", "member"))).alias("near")
    )
    named = keep(asked.join(packed, asked["id"] == packed["qid"]).select(*[quoted(f) for f in features], "near"))
    rows = query.selectExpr(quoted(key), *features_as(features))
    joined = lookup_join(rows, named, list(features), "inner", spread=F.xxhash64(col(key)))
    hits = F.filter("near", lambda x: x["member"] != col(key)) if exclude_self else F.col("near")
    return joined.select(col(key), F.posexplode(F.slice(hits, 1, k))).select(
        col(key), (F.col("pos") + 1).alias("rank"), F.col("col.member").alias("neighbour"),
        F.sqrt("col.d2").alias("distance"),
    )


def predict_vectors(index: KnnIndex, queries: DataFrame, classify: bool) -> DataFrame:
    """Prediction per query vector: mean target, or most frequent class (smaller code on a tie)."""
    return vote(index.vector_neighbours(queries), index.target, index.k, classify)


def vote(near: DataFrame, target: str, k: int, classify: bool) -> DataFrame:
    """Reduce neighbour rows to one prediction per query vector."""
    near = near.where(F.col("rank") <= k)
    y = col(target)
    if not classify:
        return near.groupBy("qid").agg(F.avg(y.cast("double")).alias("prediction"))
    votes = near.groupBy("qid", y.alias("code")).agg(F.count(F.lit(1)).alias("votes"))
    best = F.max(F.struct("votes", (-F.col("code")).alias("c"))).alias("b")
    return votes.groupBy("qid").agg(
        best, F.map_from_entries(F.collect_list(F.struct("code", F.col("votes") / k))).alias("share")
    ).select("qid", (-F.col("b.c")).cast("int").alias("prediction"), "share")


def knn_predict(index: KnnIndex, df: DataFrame, classify: bool, key: str = RUN_ID) -> DataFrame:
    """``df`` with ``prediction`` (and ``share``, the vote share per class code)."""
    asked = keep(distinct_vectors(df, index.features, key))
    said = predict_vectors(index, as_vectors(asked, index.scaler, index.features), classify)
    alias = {f: f"_f{i}" for i, f in enumerate(index.features)}
    named = keep(asked.join(said, asked["id"] == said["qid"]).drop("id", "w", "qid").withColumnsRenamed(alias))
    rows = df.selectExpr("*", *features_as(list(alias), list(alias.values())))
    return lookup_join(rows, named, list(alias.values()), "left", spread=F.xxhash64(col(key))).drop(*alias.values())
