"""Run tables derived from the given order tables, with the descriptor lookup that goes with them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chromaspark.operators.clean import Dataset, load_dataset
from chromaspark.operators.descriptors import enrich_descriptors

# Invented additive descriptors of four homologous series
# (suffix, base MolWt, base LogP, TPSA, HBD, HBA); each carbon adds 14.027 and 0.39.
SERIES = [
    ("O", 18.015, -0.78, 20.23, 1, 1),
    ("N", 17.031, -0.82, 26.02, 1, 1),
    ("C(=O)O", 46.025, -0.30, 37.30, 1, 2),
    ("c1ccccc1", 78.114, 1.69, 0.0, 0, 0),
]
CARBONS = 12
RETURN_FLAGS, LINE_STATUS = ["A", "N", "R"], ["F", "O"]  # in order


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(name: str, known: list[str]) -> Column:
    """Place of a text among the sorted ``known`` ones: odd for these, even between them, in the order of the texts.

    The least place is that of the least text, and a minimum of numbers is hashed where one of texts is sorted.
    """
    return reduce(add, [(F.col(name) >= k).cast("int") + (F.col(name) > k).cast("int") for k in known])


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chromatography run per order line: compound from the part, condition from the line."""
    line = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("partkey"), F.min("l_quantity").alias("qty"),
        F.min("l_extendedprice").alias("price"), F.min(_place("l_returnflag", RETURN_FLAGS)).alias("rf"),
        F.min(_place("l_linestatus", LINE_STATUS)).alias("ls"),
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    k = line.join(part, F.col("partkey") == F.col("p_partkey"))
    chain = F.repeat(F.lit("C"), (1 + F.col("p_size") % 12).cast("int"))
    family = F.col("partkey") % 4
    tail = F.when(family == 0, "O").when(family == 1, "N").when(family == 2, "C(=O)O").otherwise("c1ccccc1")
    smiles = F.when(F.col("partkey") % 41 == 0, None).when(
        F.col("partkey") % 37 == 0, "not_a_smiles").otherwise(F.concat(chain, tail))

    def flags(rf: str, ls: str):
        return (F.col("rf") == 2 * RETURN_FLAGS.index(rf) + 1) & (F.col("ls") == 2 * LINE_STATUS.index(ls) + 1)

    quality = (
        F.when(flags("A", "F"), "Completely separated").when(flags("A", "O"), "Switching-fully separated")
        .when(flags("N", "F"), "Switching-partialy separated").when(flags("N", "O"), "Partialy separated")
        .when(flags("R", "F"), "Overlaping")
    )
    buffer = (10 * F.ceil(F.col("qty") / 10.0)).cast("double")
    total = F.when(F.col("partkey") % 10 == 0, 95.0).otherwise(100.0)
    ph = (F.lit(2.0) + F.lit(0.5) * F.col("l_linenumber")).cast("double").cast("string")
    return k.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("run_id"),
        F.concat("p_name", F.lit(" #"), F.col("partkey").cast("string")).alias("Compound"),
        smiles.alias("SMILES"),
        F.when(F.col("l_orderkey") % 20 == 0, None).otherwise(F.round(F.col("price") / 10000.0, 3)).alias(
            "Retention_Time_min"),
        quality.alias("Separation_Quality"),
        buffer.alias("Buffer_%"),
        (total - buffer).alias("Organic_%"),
        F.when(F.col("l_orderkey") % 50 == 0, "n/a").otherwise(ph).alias("pH"),
    )


def descriptor_lookup(spark: SparkSession) -> DataFrame:
    rows = [
        ("C" * n + sfx, round(mw + 14.027 * n, 3), round(lp + 0.39 * n, 3), tpsa, hbd, hba)
        for n in range(1, CARBONS + 1) for sfx, mw, lp, tpsa, hbd, hba in SERIES
    ]
    return spark.createDataFrame(
        rows, "SMILES string, MolWt double, LogP double, TPSA double, HBD int, HBA int"
    )


_ready: dict = {}


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """Cleaned, enriched and coded runs; built once per session and folder, kept as a table."""
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _ready:
        _ready[slot] = load_dataset(enrich_descriptors(raw_runs(spark, sf_dir), descriptor_lookup(spark)))
    return _ready[slot]


def forget(spark: SparkSession) -> None:
    """Drop everything kept for this session (used between timings)."""
    _ready.clear()
    spark.catalog.clearCache()
