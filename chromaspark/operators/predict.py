"""Predictions for bare compounds and whole feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chromaspark.functions.reuse import with_ids
from chromaspark.models.base import Model
from chromaspark.operators.clean import label_text
from chromaspark.operators.descriptors import Provider, default_condition, strict_descriptors
from chromaspark.schema import RUN_ID, SMILES


def score_table(model: Model, df: DataFrame) -> DataFrame:
    """Any table with the feature columns, plus the model's prediction."""
    return model.predict(df)


def prepare_compounds(compounds: DataFrame, provider: Provider, solvents: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct known structures under the default condition, and the rejected ones."""
    unique = with_ids(compounds.select(SMILES).dropna().distinct(), RUN_ID)
    valid, rejected = strict_descriptors(unique, provider)
    return default_condition(valid, solvents), rejected.select(SMILES)


def predict_retention(model: Model, prepared: DataFrame) -> DataFrame:
    return model.predict(prepared).select(SMILES, F.col("prediction").alias("retention"))


def predict_quality(model: Model, prepared: DataFrame, labels: list[str], accuracy: float | None = None) -> DataFrame:
    """Predicted label per compound, with the model's test accuracy."""
    out = model.predict(prepared).select(
        SMILES, F.col("prediction").alias("code"), label_text(F.col("prediction"), labels).alias("label")
    )
    return out.withColumn("accuracy", F.lit(accuracy).cast("double"))
