"""What every fitted model shares, and the compressed training table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chromaspark.functions.columns import col, features_as
from chromaspark.functions.reuse import hot, keep
from chromaspark.operators.lookup import lookup_join
from chromaspark.schema import RUN_ID, quoted


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document through Spark, so any file system works."""
    text = json.dumps(value)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


@dataclass
class Model:
    """A fitted model. ``predict`` adds ``prediction`` and, for classifiers, ``probability``."""

    name: str
    task: str
    features: list[str]
    params: dict = field(default_factory=dict)
    n_labels: int = 0

    kind = "model"

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def state(self) -> dict:
        """JSON-ready parameters."""
        return {}

    def save(self, spark: SparkSession, path: str) -> None:
        write_json(spark, f"{path}/manifest", self._manifest())

    def _manifest(self) -> dict:
        head = {k: getattr(self, k) for k in ("name", "task", "features", "params", "n_labels")}
        return {"kind": self.kind, **head, "state": self.state()}


def distinct_features(df: DataFrame, features: list[str]) -> DataFrame:
    """The distinct zero-filled feature vectors of ``df``."""
    return df.selectExpr(*features_as(features)).distinct()


def predict_distinct(model: Model, df: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """What ``model.predict(df)`` returns for a table of runs, with each distinct feature vector scored once.

    ``vectors`` are the :func:`distinct_features` of ``df``, if they are at hand. Neighbour models take distinct vectors
    by themselves and linear ones are a sum of columns, so those score the rows.
    """
    if model.kind in ("knn", "linear"):
        return model.predict(df)
    asked = vectors if vectors is not None else distinct_features(df, model.features)
    alias = {f: f"_f{i}" for i, f in enumerate(model.features)}
    said = keep(model.predict(asked).withColumnsRenamed(alias))
    rows = df.selectExpr("*", *features_as(model.features, list(alias.values())))
    return lookup_join(rows, said, list(alias.values()), "left", spread=F.xxhash64(col(RUN_ID))).select(
        *[col(c) for c in df.columns], *[c for c in said.columns if c not in alias.values()]
    )


def padded(probability: Column, n_labels: int) -> Column:
    """Probability array with an entry for every class, also for classes the fit never saw."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: F.coalesce(F.get(probability, i), F.lit(0.0))
    )


def stacked(cols) -> np.ndarray:
    """Feature matrix of one Arrow batch; a single column arrives without its tuple."""
    parts = cols if isinstance(cols, tuple) else (cols,)
    return np.column_stack([c.to_numpy(dtype=np.float64) for c in parts])


@dataclass
class TrainingTable:
    """Training rows and their compressed form.

    ``rows`` has (run_id, features, y, fold). ``packed`` has one row per distinct (features, fold) for
    regression - weight ``w``, mean target ``y``, squared spread ``ss`` - and per distinct (features,
    fold, class) for classification. Losses that are sums over rows are unchanged by the packing.
    """

    rows: DataFrame
    packed: DataFrame
    features: list[str]
    task: str
    n_labels: int = 0
    folds: int = 3
    binned: object = None  # blocks of bins, made by the first tree model that asks


def training_table(
    df: DataFrame, features: list[str], y: str, task: str, n_labels: int = 0, folds: int = 3
) -> TrainingTable:
    """``df`` needs run_id, features, ``y`` and ``fold``."""
    kind = "double" if task == "regression" else "int"
    rows = keep(df.selectExpr(
        RUN_ID, *features_as(features), f"cast({quoted(y)} AS {kind}) AS y",
        "fold" if "fold" in df.columns else "0 AS fold",
    ))
    keys = list(features)
    if task == "regression":
        packed = rows.groupBy(*keys, "fold").agg(
            F.expr("cast(count(1) AS double) AS w"), F.expr("avg(y) AS _m"),
            F.expr("coalesce(var_pop(y), 0D) * count(1) AS ss"),
        ).withColumnRenamed("_m", "y")
    else:
        packed = rows.groupBy(*keys, "fold", "y").agg(F.expr("cast(count(1) AS double) AS w"))
        packed = packed.withColumn("ss", F.lit(0.0))
    return TrainingTable(rows, hot(keep(packed)), list(features), task, n_labels, folds)


SCORES = {
    "regression": "sqrt(sum(w * (y - prediction) * (y - prediction) + ss) / sum(w))",
    "classification": "sum(CASE WHEN y = prediction THEN w ELSE 0D END) / sum(w)",
}


def packed_score(scored: DataFrame, task: str) -> float:
    """RMSE or accuracy of predictions on packed rows, equal to the score on the single rows."""
    value = scored.selectExpr(f"{SCORES[task]} AS s").first()["s"]
    return float(value) if value is not None else float("nan")
