"""Scoring runs as they arrive: stream-static enrichment followed by a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chromaspark.functions.columns import col
from chromaspark.functions.reuse import passing
from chromaspark.models.base import Model
from chromaspark.operators.clean import clean_numbers, coerce_ph, fill_labels
from chromaspark.operators.descriptors import enrich_descriptors
from chromaspark.schema import DESCRIPTOR_TYPES, SMILES


def stream_runs(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """File stream of Parquet run slices."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(runs: DataFrame, lookup: DataFrame, model: Model) -> DataFrame:
    """Clean, enrich (static lookup join) and score a stream of runs; stateless, so no watermark."""
    ready = fill_labels(coerce_ph(clean_numbers(runs)))
    known = lookup.select(SMILES, *[col(d).cast(t).alias(d) for d, t in DESCRIPTOR_TYPES.items()])
    joined = ready.join(known.dropDuplicates([SMILES]), SMILES, "left")
    filled = joined.withColumns({d: F.coalesce(col(d), F.lit(0).cast(t)) for d, t in DESCRIPTOR_TYPES.items()})
    return model.predict(filled)


def run_once(scored: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything available into Parquet, then stop; safe to call again for new files."""
    query = (
        scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batches(runs: DataFrame, lookup: DataFrame, model: Model, columns: list[str], out: str, checkpoint: str) -> None:
    """Score everything available with any model, neighbour models too, then stop; safe to call again for new files.

    A model that joins, aggregates or ranks cannot work on the stream itself, so each micro-batch is scored as
    a table: cleaned, enriched by the size-checked lookup join and predicted. Batch ``n`` is the folder
    ``out/batch=n``, which is replaced if a restart repeats the batch, so no run is there twice. What a batch keeps
    on the way is deleted at its end.
    """

    def land(batch: DataFrame, number: int) -> None:
        with passing(batch.sparkSession):
            ready = enrich_descriptors(fill_labels(coerce_ph(clean_numbers(batch))), lookup)
            model.predict(ready).select(*[col(c) for c in columns]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = runs.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
