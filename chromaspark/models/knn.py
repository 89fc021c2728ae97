"""Nearest-neighbour regression and classification on top of the neighbour join."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, functions as F

from chromaspark.functions.reuse import keep
from chromaspark.models.base import SCORES, Model, TrainingTable
from chromaspark.operators.moments import Scaler, fit_scaler
from chromaspark.operators.neighbours import KnnIndex, as_vectors, first_members, fit_knn, knn_predict
from chromaspark.schema import RUN_ID, quoted


@dataclass
class KnnModel(Model):
    index: KnnIndex | None = None
    kind = "knn"

    def predict(self, df: DataFrame) -> DataFrame:
        classify = self.task == "classification"
        out = knn_predict(self.index, df, classify)
        if not classify:
            return out
        share = F.transform(
            F.sequence(F.lit(0), F.lit(self.n_labels - 1)),
            lambda i: F.coalesce(F.try_element_at("share", i), F.lit(0.0)),
        )
        return out.withColumn("probability", share).drop("share")

    def state(self) -> dict:
        s = self.index.scaler
        return {"k": self.index.k, "mean": s.mean, "std": s.std}

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        self.index.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.index.members.write.mode("overwrite").parquet(f"{path}/members")


def fit(table: TrainingTable, params: dict) -> KnnModel:
    index = fit_knn(table.rows, table.features, int(params.get("n_neighbors", 5)), "y")
    return KnnModel("KNN", table.task, list(table.features), dict(params), table.n_labels, index)


def _votes_for(near: DataFrame, sizes: list[int], classify: bool) -> DataFrame:
    """Predictions ``p0..`` per query vector, one for each neighbour count, in one reduction."""
    if not classify:
        return near.groupBy("qid").agg(*[
            F.expr(f"avg(CASE WHEN rank <= {k} THEN y END) AS p{i}") for i, k in enumerate(sizes)
        ])
    votes = near.groupBy("qid", "y").agg(*[
        F.expr(f"count(CASE WHEN rank <= {k} THEN 1 END) AS c{i}") for i, k in enumerate(sizes)
    ])
    return votes.groupBy("qid").agg(*[F.expr(f"-max(struct(c{i}, -y)).col2 AS p{i}") for i in range(len(sizes))])


def cv_scores(table: TrainingTable, grid: list[dict], parallelism: int = 3) -> list[tuple[int, int, float]]:
    """``(grid_id, fold, score)``; one neighbour search per fold serves every k of the grid.

    The distinct vectors and first members of all folds are taken from the rows once; what a fold leaves follows from them.
    """
    sizes = [int(p.get("n_neighbors", 5)) for p in grid]
    classify, k = table.task == "classification", max(sizes)
    names = [quoted(c) for c in table.features]
    least = keep(table.rows.groupBy(*names, "fold").agg(F.min(RUN_ID).alias("id"), F.count(F.lit(1)).cast("double").alias("w")))
    over = ", ".join([*names, "fold"])
    ranked = table.rows.selectExpr("*", f"row_number() OVER (PARTITION BY {over} ORDER BY {RUN_ID}) AS rn")
    few = keep(ranked.where(f"rn <= {k}").drop("rn"))

    def one(f: int) -> list[tuple[int, int, float]]:
        rest = F.col("fold") != f
        scaler = fit_scaler(table.rows.where(rest), table.features)
        vectors = least.where(rest).groupBy(*names).agg(F.min("id").alias("id"), F.sum("w").alias("w"))
        members = keep(first_members(few.where(rest), table.features, k, ["y"]))
        index = KnnIndex(list(table.features), scaler, k, keep(as_vectors(vectors, scaler, table.features)), members, "y")
        asked = least.where(F.col("fold") == f)
        near = index.vector_neighbours(as_vectors(asked, index.scaler, table.features))
        said = _votes_for(near, sizes, classify).withColumnRenamed("qid", "id")
        named = asked.select("id", *names).join(said, "id")
        scored = table.packed.where(F.col("fold") == f).join(named, list(table.features))
        row = scored.selectExpr(*[
            f"{SCORES[table.task].replace('prediction', f'p{i}')} AS s{i}" for i in range(len(grid))
        ]).first()
        return [(i, f, float(row[f"s{i}"])) for i in range(len(grid)) if row[f"s{i}"] is not None]

    with ThreadPool(max(1, parallelism)) as pool:  # the jobs of a fold are short
        return [score for scores in pool.map(one, range(table.folds), chunksize=1) for score in scores]


def load(spark: SparkSession, path: str, head: dict) -> KnnModel:
    s = head["state"]
    index = KnnIndex(
        head["features"], Scaler(head["features"], s["mean"], s["std"]), s["k"],
        keep(spark.read.parquet(f"{path}/vectors")), keep(spark.read.parquet(f"{path}/members")), "y",
    )
    return KnnModel(head["name"], head["task"], head["features"], head["params"], head["n_labels"], index)
