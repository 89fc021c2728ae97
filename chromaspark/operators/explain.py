"""Which features a tree model relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromaspark.models.base import Model

SCHEMA = "rank int, feature string, importance double"


def feature_importance(spark: SparkSession, model: Model) -> DataFrame:
    """``(rank, feature, importance)``; equal values rank the later feature first. Empty if not a tree."""
    if not hasattr(model, "importances"):
        return spark.createDataFrame([], SCHEMA)
    values = list(enumerate(model.importances()))
    ordered = sorted(values, key=lambda iv: (-iv[1], -iv[0]))
    rows = [(r, model.features[i], v) for r, (i, v) in enumerate(ordered, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def most_influential(spark: SparkSession, model: Model) -> DataFrame:
    return feature_importance(spark, model).where("rank = 1")
