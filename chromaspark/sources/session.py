"""Saving and restoring models and whole sessions as Parquet, model folders and JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from chromaspark.models.base import Model, read_json, write_json
from chromaspark.models.catalog import load_model
from chromaspark.models.tune import TrainResult
from chromaspark.operators.clean import Dataset
from chromaspark.schema import QUALITY_CODE, RETENTION

SHORT = {"regression": "reg", "classification": "clf"}


def save_models(spark: SparkSession, results: list[TrainResult], folder: str) -> dict[str, str]:
    """Every fitted model and the best of each task; returns name to path."""
    paths: dict[str, str] = {}
    for r in results:
        for name, model in r.models.items():
            key = f"model_{SHORT[r.task]}_{name}"
            paths[key] = f"{folder}/{key}"
            model.save(spark, paths[key])
        if r.best_name():
            paths[f"best_model_{r.task}"] = paths[f"model_{SHORT[r.task]}_{r.best_name()}"]
    names = {k: p[len(folder) + 1 :] for k, p in paths.items()}
    write_json(spark, f"{folder}/models", names)
    return paths


def load_models(spark: SparkSession, folder: str) -> dict[str, Model]:
    """Saved models by name, ready to predict."""
    names = read_json(spark, f"{folder}/models")
    loaded = {p: load_model(spark, f"{folder}/{p}") for p in sorted(set(names.values()))}
    return {k: loaded[p] for k, p in names.items()}


@dataclass
class Session:
    """A dataset with the results and tables computed from it."""

    dataset: Dataset
    results: list[TrainResult] = field(default_factory=list)
    heatmap: DataFrame | None = None


def save_session(spark: SparkSession, session: Session, folder: str) -> None:
    """Tables as Parquet, models as folders, the rest as one JSON manifest."""
    ds = session.dataset
    ds.df.write.mode("overwrite").parquet(f"{folder}/data")
    if ds.chromatogram is not None:
        ds.chromatogram.write.mode("overwrite").parquet(f"{folder}/chromatogram")
    if session.heatmap is not None:
        session.heatmap.write.mode("overwrite").parquet(f"{folder}/heatmap")
    save_models(spark, session.results, f"{folder}/trained")
    tasks = []
    for r in session.results:
        if r.metrics is not None:
            r.metrics.write.mode("overwrite").parquet(f"{folder}/metrics_{r.task}")
            r.test.write.mode("overwrite").parquet(f"{folder}/test_{r.task}")
        tasks.append({"task": r.task, "features": r.features, "labels": r.labels, "models": list(r.models),
                      "trained": r.metrics is not None, "skipped": r.skipped})
    write_json(spark, f"{folder}/session", {
        "labels": ds.labels, "solvents": ds.solvents, "chromatogram": ds.chromatogram is not None,
        "heatmap": session.heatmap is not None, "tasks": tasks,
    })


def load_session(spark: SparkSession, folder: str) -> Session:
    head = read_json(spark, f"{folder}/session")
    side = spark.read.parquet(f"{folder}/chromatogram") if head["chromatogram"] else None
    ds = Dataset(spark.read.parquet(f"{folder}/data"), head["labels"], head["solvents"], side)
    models = load_models(spark, f"{folder}/trained")
    results = []
    for t in head["tasks"]:
        target = RETENTION if t["task"] == "regression" else QUALITY_CODE
        r = TrainResult(t["task"], t["features"], t["labels"], target=target, skipped=t["skipped"])
        if t["trained"]:
            r.metrics = spark.read.parquet(f"{folder}/metrics_{t['task']}")
            r.test = spark.read.parquet(f"{folder}/test_{t['task']}")
            r.models = {m: models[f"model_{SHORT[t['task']]}_{m}"] for m in t["models"]}
        results.append(r)
    heatmap = spark.read.parquet(f"{folder}/heatmap") if head["heatmap"] else None
    return Session(ds, results, heatmap)
