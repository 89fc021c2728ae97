"""Reading and writing run tables."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chromaspark.functions.columns import col, to_number
from chromaspark.schema import NA_TOKENS, RETENTION, RUN_ID, quoted, solvent_columns

SUFFIXES = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def source_format(path: str, fmt: str | None = None) -> str:
    """Format by case-insensitive suffix; ``fmt`` overrides it."""
    if fmt is not None:
        if fmt not in (*SUFFIXES.values(), "table"):
            raise ValueError(f"unknown format {fmt!r}: use csv, parquet, json or table")
        return fmt
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUFFIXES:
        raise ValueError("Input must be .csv, .parquet or .json")
    return SUFFIXES[suffix]


def _missing_to_null(df: DataFrame) -> DataFrame:
    tokens = ", ".join(f"'{t}'" for t in NA_TOKENS)
    return df.selectExpr(*[f"CASE WHEN {quoted(c)} NOT IN ({tokens}) THEN {quoted(c)} END AS {quoted(c)}" for c in df.columns])


def content_key(df: DataFrame, key: str = RUN_ID) -> DataFrame:
    """Put a key column in front: a hash of the row's content and, among equal rows, of their number.

    The keys of a table are the same however it is partitioned or its files are split.
    """
    text = [F.coalesce(col(c).cast("string"), F.lit("")) for c in df.columns]
    nulls = [col(c).isNull() for c in df.columns]
    hashed = df.withColumn("_h", F.xxhash64(*nulls, *text))
    copy = F.row_number().over(Window.partitionBy("_h").orderBy("_h"))
    numbered = hashed.withColumn("_copy", copy)
    return numbered.select(F.when(F.col("_copy") == 1, F.col("_h")).otherwise(F.xxhash64("_h", "_copy")).alias(key), *[col(c) for c in df.columns])


def read_runs(spark: SparkSession, path: str, fmt: str | None = None, key: str = RUN_ID) -> DataFrame:
    """Run table from CSV, Parquet, JSON or a catalogue table.

    CSV is read as text without an inference pass; missing-value tokens become NULL and the known
    numeric columns are parsed. Fields may hold quoted line breaks, so one task reads a CSV file as a
    whole. A table without a key gets one from its content (:func:`content_key`).
    """
    kind = source_format(path, fmt)
    if kind == "table":
        df = spark.read.table(path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "json":
        df = spark.read.json(path)
    else:
        text = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        df = _missing_to_null(text)
        for name in [*solvent_columns(df), RETENTION]:
            if name in df.columns:
                df = df.withColumn(name, to_number(name))
        if key in df.columns:
            df = df.withColumn(key, col(key).try_cast("bigint"))
    if key not in df.columns:
        df = content_key(df, key)
    return df


@dataclass
class RunFiles:
    runs: DataFrame
    chromatogram: DataFrame | None = None


def read_dataset(
    spark: SparkSession, runs_path: str, chromatogram_path: str | None = None, fmt: str | None = None
) -> RunFiles:
    """Runs with an optional chromatogram table, which is passed through untouched."""
    side = None
    if chromatogram_path:
        kind = source_format(chromatogram_path)
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True) if kind == "csv" else spark.read
        side = reader.format(kind).load(chromatogram_path)
    return RunFiles(read_runs(spark, runs_path, fmt), side)


def write_runs(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a run table as a folder of CSV (with header) or Parquet files."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: use csv or parquet")


