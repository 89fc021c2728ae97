"""Centred principal components from one Gram aggregation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from chromaspark.functions.columns import col, dot
from chromaspark.operators.moments import gram
from chromaspark.schema import RUN_ID


@dataclass
class PcaFit:
    features: list[str]
    mean: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray
    total: float

    def scores(self, df: DataFrame, key: str = RUN_ID, extra: list[str] | None = None) -> DataFrame:
        """``(key, pc1..)``: a projection, no Python and no shuffle."""
        cells = [
            dot(self.features, self.loadings[:, j], -float(self.loadings[:, j] @ self.mean)).alias(f"pc{j + 1}")
            for j in range(self.loadings.shape[1])
        ]
        return df.select(col(key), *cells, *[col(c) for c in extra or []])

    def ratio(self) -> list[float]:
        return [float(v / self.total) if self.total > 0 else 0.0 for v in self.variance]

    def variance_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f"PC{i + 1}", float(v), r) for i, (v, r) in enumerate(zip(self.variance, self.ratio()))]
        return spark.createDataFrame(rows, "component string, variance double, ratio double")

    def loadings_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (f, f"PC{j + 1}", float(self.loadings[i, j]))
            for i, f in enumerate(self.features) for j in range(self.loadings.shape[1])
        ]
        return spark.createDataFrame(rows, "feature string, component string, loading double")


def pca(df: DataFrame, features: list[str], components: int = 3) -> PcaFit:
    """Eigenvectors of the sample covariance; the largest loading of each is made positive."""
    g = gram(df, features)
    values, vectors = np.linalg.eigh(g.xx / max(g.n - 1.0, 1.0))
    order = np.argsort(values)[::-1][: min(components, len(features))]
    load = vectors[:, order]
    big = load[np.argmax(np.abs(load), axis=0), np.arange(load.shape[1])]
    load = load * np.where(big < 0, -1.0, 1.0)
    return PcaFit(list(features), g.mean, load, np.maximum(values[order], 0.0), float(np.trace(g.xx) / max(g.n - 1.0, 1.0)))


def scatter(scores: DataFrame, df: DataFrame, label: str, key: str = RUN_ID, text_limit: int = 30) -> DataFrame:
    """Coordinates with each run's label; ``show_text`` marks plots small enough to name points."""
    few = len(scores.limit(text_limit + 1).select(col(key)).collect()) <= text_limit
    return scores.join(df.select(col(key), col(label).alias("label")), key).withColumn("show_text", F.lit(few))
