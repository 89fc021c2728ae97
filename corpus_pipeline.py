"""From raw documents to token ids, in four stages; each reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chromaspark.llm import bpe, decontaminate, language, similar
from chromaspark.llm.common import TEXT_ROWS, new_folder


def _few_texts(spark: SparkSession) -> None:
    """The session sends whole texts to Python a thousand at a time, also where a stage's result is written after it returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language (no letters, or no language clearly ahead) go."""
    _few_texts(spark)
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word similarity of 0.8 or more, the one with the smallest id stays."""
    _few_texts(spark)
    return similar.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold part of a benchmark text go."""
    _few_texts(spark)
    return decontaminate.keep_clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with checksums of the ids and of the text decoded from them."""
    _few_texts(spark)
    encoded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(encoded)


STAGES = [
    ("language ID", language_id), ("near-dedup", near_duplicates), ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", token_ids),
]

ORACLE_SQL = None  # naive Bayes, MinHash and BPE are beyond SQL; tests/llm compares the stages with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; every stage's result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
