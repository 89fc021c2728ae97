"""Logistic regression and margin classifiers on packed rows, with Spark ML's logistic fit."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from chromaspark.functions.descent import lbfgs, solved
from chromaspark.models.base import Model, TrainingTable, padded
from chromaspark.models.kernel import MAX_STEPS, FourierMap, fourier_map, margins
from chromaspark.operators.moments import Scaler, fit_scaler

@dataclass
class LogisticModel(Model):
    scaler: Scaler | None = None
    fitted: Transformer | None = None
    kind = "logistic"

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.fitted.transform(df.withColumn("_x", array_to_vector(self.scaler.array())))
        p = padded(vector_to_array(F.col("probability")), self.n_labels)
        out = out.withColumn("_p", p).withColumn("_c", F.col("prediction").cast("int"))
        return out.drop("_x", "rawPrediction", "probability", "prediction").withColumnsRenamed(
            {"_p": "probability", "_c": "prediction"})

    def state(self) -> dict:
        return {"mean": self.scaler.mean, "std": self.scaler.std}

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        self.fitted.write().overwrite().save(f"{path}/fitted")


def fit_logistic(table: TrainingTable, params: dict) -> LogisticModel:
    """C * sum log-loss + 1/2 |w|^2 on scaled features, intercepts free."""
    scaler = fit_scaler(table.packed, table.features, weight="w")
    n = table.packed.agg(F.sum("w")).first()[0]
    frame = table.packed.select(
        array_to_vector(scaler.array()).alias("_x"), F.col("y").cast("double").alias("y"), "w"
    )
    est = LogisticRegression(
        featuresCol="_x", labelCol="y", weightCol="w", regParam=1.0 / (float(params.get("C", 1.0)) * n),
        elasticNetParam=0.0, standardization=False, maxIter=int(params.get("max_iter", 500)), tol=1e-7,
    )
    return LogisticModel("LR", "classification", list(table.features), dict(params), table.n_labels, scaler, est.fit(frame))


@dataclass
class SvcModel(Model):
    """Fourier features, one margin per class, calibrated probabilities."""

    fmap: FourierMap | None = None
    coef: list[list[float]] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    platt: LogisticRegressionModel | None = None
    history: list[float] = field(default_factory=list)
    converged: bool | None = None  # None for a loaded model
    kind = "svc"

    def predict(self, df: DataFrame) -> DataFrame:
        wide = df.withColumn("_a", margins(self.features, self.fmap, np.array(self.coef), np.array(self.bias)))
        wide = wide.withColumn("_m", array_to_vector("_a"))
        best = (F.array_position("_a", F.array_max("_a")) - 1).cast("int")
        out = self.platt.transform(wide.withColumn("_c", best))
        out = out.withColumn("_p", padded(vector_to_array(F.col("probability")), self.n_labels))
        return out.drop("_a", "_m", "_r", "probability", "prediction").withColumnsRenamed(
            {"_p": "probability", "_c": "prediction"})

    def state(self) -> dict:
        return {"map": self.fmap.state(), "coef": self.coef, "bias": self.bias}

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        self.platt.write().overwrite().save(f"{path}/platt")


def fit_svc(table: TrainingTable, params: dict) -> SvcModel:
    """RBF margins of every class against the rest, fitted together in one pass per step.

    1/2 |w|^2 + C * sum hinge per class, with the hinge rounded at its corner. Probabilities come from
    a logistic fit on the margins. ``converged`` tells whether the value settled within ``max_iter`` steps.
    """
    packed, features, k = table.packed, table.features, table.n_labels
    scaler = fit_scaler(packed, features, weight="w")
    fmap = fourier_map(scaler, gamma=params.get("gamma", "scale"))
    m, c = len(fmap.phase), float(params.get("C", 1.0))
    n = float(packed.agg(F.sum("w")).first()[0])
    rounds = int(params.get("max_iter", MAX_STEPS))

    def solve(sums):
        def value_and_grad(flat: np.ndarray) -> tuple[float, np.ndarray]:
            w = flat.reshape(m + 1, k)

            def part(b: dict) -> np.ndarray:
                if "_h" not in b:  # the same for all steps, where the rows stay
                    h = fmap.numpy(np.column_stack([b[f] for f in features]).astype(np.float64))
                    b["_h"] = np.hstack([h, np.ones((len(h), 1))])
                h = b["_h"]
                sign = np.where(b["y"].astype(np.int64)[:, None] == np.arange(k)[None, :], 1.0, -1.0)
                short = 1.0 - sign * (h @ w)
                loss = np.where(short >= CORNER, short - CORNER / 2, np.where(short > 0, short * short / (2 * CORNER), 0.0))
                slope = -sign * np.clip(short / CORNER, 0.0, 1.0) * b["w"][:, None]
                return np.concatenate([[float((loss * b["w"][:, None]).sum())], (h.T @ slope).ravel()])

            s = sums(part)
            free = np.vstack([w[:-1], np.zeros((1, k))])
            value = (0.5 * np.sum(free * free) + c * s[0]) / n
            return float(value), (free.ravel() + c * s[1:]) / n

        return lbfgs(value_and_grad, np.zeros((m + 1) * k), rounds=rounds, tol=1e-3)

    w, history, converged = solved(packed, [*features, "y", "w"], solve)
    w = w.reshape(m + 1, k)
    coef, bias = w[:-1].T, w[-1]
    scored = packed.select(
        array_to_vector(margins(features, fmap, coef, bias)).alias("_m"), F.col("y").cast("double").alias("y"), "w"
    ).persist()
    platt = LogisticRegression(featuresCol="_m", labelCol="y", weightCol="w", rawPredictionCol="_r", maxIter=50, tol=1e-4)
    fitted = platt.fit(scored)
    scored.unpersist()
    return SvcModel("SVC", "classification", list(features), dict(params), k, fmap, coef.tolist(), bias.tolist(), fitted, history, converged)


CORNER = 0.1  # width of the rounded corner of the hinge
