"""Result tables and the text report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chromaspark.models.tune import TrainResult, results_table
from chromaspark.operators.clean import Dataset, cut_text
from chromaspark.operators.explain import feature_importance
from chromaspark.schema import DESCRIPTORS, PH

METRIC_COLUMNS = {
    "regression": ["model", "rmse", "r2", "mae", "params"],
    "classification": ["model", "accuracy", "precision", "recall", "f1", "support", "params"],
}


def write_results(results: list[TrainResult], folder: str, fmt: str = "csv") -> list[str]:
    """One metrics table per task under ``folder``; returns the paths."""
    paths = []
    for r in results:
        if r.metrics is None:
            continue
        path = f"{folder}/{r.task}_results"
        table = r.metrics.orderBy("catalog_pos").select(*METRIC_COLUMNS[r.task]).coalesce(1)  # one row per model
        writer = table.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.parquet(path)
        paths.append(path)
    return paths


def results_preview(results: list[TrainResult], width: int = 100) -> DataFrame:
    """Stacked metrics as text, every value cut at ``width`` characters."""
    table = results_table(*results)
    return table.select(*[cut_text(F.col(c), width).alias(c) for c in table.columns])


def _metric_lines(result: TrainResult) -> list[str]:
    columns = METRIC_COLUMNS[result.task]
    rows = result.metrics.orderBy("catalog_pos").select(*columns).collect()  # one row per model

    def show(v) -> str:
        return f"{v:.4f}" if isinstance(v, float) else str(v)

    return [" | ".join(columns)] + [" | ".join(show(r[c]) for c in columns) for r in rows]


def report_lines(
    spark: SparkSession, ds: Dataset, results: list[TrainResult], best: DataFrame | None = None
) -> DataFrame:
    """Details of a training run as ``(section, line_no, text)``.

    ``best`` is the one-row (or empty) best condition.
    """
    sections: list[tuple[str, list[str]]] = []
    for r in results:
        if r.metrics is None:
            sections.append((f"{r.task} models", [f"skipped: {r.skipped}"]))
            continue
        sections.append((f"{r.task} models", _metric_lines(r)))
        if r.task == "classification" and r.best is not None:
            rows = feature_importance(spark, r.best).orderBy("rank").collect()  # one row per feature
            if rows:
                lines = [f"{x['rank']} | {x['feature']} | {x['importance']:.4f}" for x in rows]
                sections.append(("feature importance", lines))
    sections.append(("features", [
        "Solvents: " + ", ".join(ds.solvents), "Molecular descriptors: " + ", ".join(DESCRIPTORS), f"Additional: {PH}",
    ]))
    if best is not None:
        row = best.first()
        if row is None:
            text = "No observed condition reaches a listed quality."
        else:
            parts = [f"pH={row['pH']:.2f}", f"{ds.solvents[0]}={row['org']:.1f}"]
            if len(ds.solvents) > 1:
                parts.append(f"{ds.solvents[1]}={row['buf']:.1f}")
            text = f"Best observed condition: {', '.join(parts)} -> {row['label']}"
        sections.append(("suggestion", [text]))
    rows = [(s, i, t) for s, lines in sections for i, t in enumerate(lines)]
    numbered = [(s, n, t) for n, (s, _, t) in enumerate(rows)]
    return spark.createDataFrame(numbered, "section string, line_no int, text string")


def write_report(lines: DataFrame, path: str) -> None:
    """Report as one text file in line order (a page of text)."""
    lines.orderBy("line_no").coalesce(1).select("text").write.mode("overwrite").text(path)
