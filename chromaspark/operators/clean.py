"""Cleaning, feature projection and label coding of run tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chromaspark.functions.columns import clean_double, col, cut_text, features_as, run_label, to_number
from chromaspark.functions.reuse import collect_bounded, keep
from chromaspark.schema import (
    NO_DATA, PH, QUALITY, QUALITY_CODE, RETENTION, RUN_ID, feature_columns, quoted, solvent_columns,
)

MAX_LABELS = 10_000


@dataclass
class Dataset:
    """A cleaned run table with everything needed to train on it."""

    df: DataFrame
    labels: list[str]
    solvents: list[str] = field(default_factory=list)
    chromatogram: DataFrame | None = None

    @property
    def features(self) -> list[str]:
        return feature_columns(self.solvents)


def coerce_ph(df: DataFrame) -> DataFrame:
    """pH as a number; unreadable values become NULL. A table without pH is left alone."""
    return df.withColumn(PH, to_number(PH)) if PH in df.columns else df


def fill_labels(df: DataFrame) -> DataFrame:
    """Missing separation quality becomes its own label."""
    return df.withColumn(QUALITY, F.coalesce(col(QUALITY), F.lit(NO_DATA))) if QUALITY in df.columns else df


def label_list(df: DataFrame, column: str = QUALITY) -> list[str]:
    """Distinct labels in sorted order; the position is the code. Bounded by ``MAX_LABELS``."""
    distinct = df.select(col(column).alias("label")).dropna().distinct()
    return sorted(r["label"] for r in collect_bounded(distinct, MAX_LABELS, f"labels of {column}"))


def label_table(spark: SparkSession, labels: list[str]) -> DataFrame:
    """Label dimension ``(code, label)``."""
    schema = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("label", T.StringType())])
    return spark.createDataFrame([(i, s) for i, s in enumerate(labels)], schema)


def label_code(c: Column, labels: list[str]) -> Column:
    """Code of a label (its sorted position), NULL for an unknown one. No join needed."""
    known = F.array(*[F.lit(s) for s in labels]) if labels else F.array().cast("array<string>")
    position = F.array_position(known, c).cast("int")
    return F.when(position > 0, position - 1)


def label_text(code: Column, labels: list[str]) -> Column:
    """Label of a code, NULL when out of range."""
    known = F.array(*[F.lit(s) for s in labels]) if labels else F.array().cast("array<string>")
    return F.when((code >= 0) & (code < len(labels)), F.get(known, code.cast("int")))


def encode_labels(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.withColumn(QUALITY_CODE, label_code(col(QUALITY), labels))


def decode_labels(df: DataFrame, labels: list[str], code: str = QUALITY_CODE, out: str = "label") -> DataFrame:
    return df.withColumn(out, label_text(col(code), labels))


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN to NULL in the retention and solvent columns."""
    for name in [*solvent_columns(df), RETENTION]:
        if name in df.columns:
            df = df.withColumn(name, clean_double(name))
    return df


def load_dataset(df: DataFrame, chromatogram: DataFrame | None = None) -> Dataset:
    """Clean a run table that already carries descriptors and code its labels.

    The cleaned rows are kept, so ``df`` is made once; the code is a projection of the label beside it.
    """
    ready = keep(fill_labels(coerce_ph(clean_numbers(df))))
    labels: list[str] = []
    if QUALITY in ready.columns:
        labels = label_list(ready)
        ready = encode_labels(ready, labels)
    return Dataset(ready, labels, solvent_columns(df), chromatogram)


def feature_table(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Key, features in fixed order with missing values as 0, then ``extra`` columns."""
    feats = feature_columns(df)
    return df.selectExpr(
        quoted(RUN_ID), *features_as(feats), *[quoted(c) for c in extra or []]
    )


def known_target(df: DataFrame, target: str = RETENTION) -> DataFrame:
    """Rows whose target is known."""
    return df.where(clean_double(target).isNotNull())


def has_target(df: DataFrame, target: str) -> bool:
    """Whether a task can run at all: the column exists and some row has a value."""
    return target in df.columns and not df.where(col(target).isNotNull()).isEmpty()


def with_run_label(df: DataFrame, out: str = "run_label") -> DataFrame:
    return df.withColumn(
        out, run_label(col("Compound"), col("Buffer_%"), col("Organic_%"), col(PH))
    )


def preview(df: DataFrame, n: int = 1000, width: int = 50, key: str = RUN_ID) -> DataFrame:
    """The first ``n`` rows by key, every value as text cut at ``width`` characters."""
    top = df.orderBy(col(key)).limit(n)
    return top.select(col(key), *[cut_text(col(c), width).alias(c) for c in df.columns if c != key])


def summary(df: DataFrame) -> DataFrame:
    """One row: number of rows, number of columns, column names."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"), F.lit(",".join(df.columns)).alias("columns")
    )


def class_counts(df: DataFrame, code: str = QUALITY_CODE) -> DataFrame:
    """Rows per class."""
    return df.groupBy(col(code)).agg(F.count(F.lit(1)).alias("n"))


def can_classify(df: DataFrame, code: str = QUALITY_CODE) -> bool:
    """Classification needs at least two rows in every class."""
    low = class_counts(df, code).agg(F.min("n").alias("low")).first()["low"]
    return low is not None and low >= 2


def axis_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct known values of a column in ascending order."""
    return df.select(col(column).alias("value")).dropna().distinct().orderBy("value")
