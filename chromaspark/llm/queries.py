"""The registered queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from chromaspark.llm import (
    bpe, chat, decontaminate, edit_counts, forest, language, secrets, shards, simhash, token_files, url_lists, variants, whitening,
)

END_ID = 2
SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = token_files.write_token_files(_table(spark, sf_dir, "documents"), path, END_ID)
    return token_files.read_token_files(spark, folder)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.encode_decode(_table(spark, sf_dir, "documents"), path))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def dated_pages(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date; the table has none, so it follows from the id."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id * 7919, 360) AS INT))").alias("fetched_on"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries for some of the hosts and pages of the table, added, removed and added again."""
    bare = pages.where("url IS NOT NULL").select(url_lists.canonical(F.col("url")).alias("bare"))
    hosts = bare.select(F.concat(F.lit("domain:"), F.regexp_replace(F.split_part("bare", F.lit("/"), F.lit(1)), r"^(www|m|blog)\.", "")).alias("pattern"))
    paths = bare.select(F.concat(F.lit("path:"), F.col("bare")).alias("pattern"))
    h = F.expr("CAST(conv(substring(md5(pattern), 1, 8), 16, 10) AS BIGINT)").alias("h")
    some = hosts.distinct().select("pattern", h, F.lit("hosts").alias("list")).where("h % 5 = 0").union(
        paths.distinct().select("pattern", h, F.lit("pages").alias("list")).where("h % 20 = 0")
    )
    return some.selectExpr("list", "pattern", """inline(array_compact(array(
        named_struct('day', date_add(DATE'2024-01-01', CAST(h % 200 AS INT)), 'action', 'add'),
        named_struct('day', date_add(DATE'2024-01-01', CAST(h % 200 + 30 + h % 61 AS INT)), 'action', 'remove'),
        CASE WHEN h % 3 = 0 THEN named_struct('day', date_add(DATE'2024-01-01', CAST(h % 200 + 120 AS INT)), 'action', 'add') END)))""")


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = url_lists.filter_urls(dated_pages(pages), dated_entries(pages))
    return judged.select(
        "capture.page_id", F.col("capture.fetched_on").cast("string").alias("fetched_on"), (F.col("verdict.hits") > 0).alias("blocked"),
        "verdict.hits", F.col("verdict.list").alias("list_name"), "verdict.pattern",
        *[F.col(f"verdict.{c}").cast("string").alias(c) for c in ("since", "until")],
    )


def op5_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = shards.read_shards(spark, shards.write_shards(docs, SHARDS), docs.schema)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "size", F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def derived_edits(docs: DataFrame) -> DataFrame:
    """Up to four edits of each document: words replaced, put in and taken out at places that follow from the id."""
    return docs.where("text IS NOT NULL AND length(text) > 0").selectExpr("doc_id", "length(text) AS n").selectExpr("doc_id", """inline(transform(
        sequence(0, 3), i -> named_struct(
            'start', pmod(doc_id * 7919 + i * 104729, n), 'end', pmod(doc_id * 7919 + i * 104729, n) + pmod(doc_id + i, 9),
            'replacement', CASE i WHEN 0 THEN ' new words' WHEN 1 THEN '' WHEN 2 THEN '\\n' ELSE concat('x', CAST(doc_id AS STRING)) END)))""")


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents")
    edited = edit_counts.apply_edits(edit_counts.build(docs, path), derived_edits(docs), path)
    return edited.select("doc_id", "n_before", "n_tokens", "n_edits", "n_skipped", "n_encoded", F.sha2("text", 256).alias("text_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_token_files, op2_bpe, op3_chat_format, op4_url_lists, op5_forest_search, op6_shards, op7_edit_counts,
        op8_decontaminate, op9_simhash, op10_language, op11_secrets, op12_variants, op13_whitening,
    ]
    return {f.__name__: f for f in own} | {"pipeline": _pipeline}
