"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from chromaspark.functions.reuse import session_folder

BATCH_BYTES = 4 << 20
TEXT_ROWS = 1000
FILE_BITS = 24  # of a place: at most 16 M files of 2^39 rows
BROADCAST_FILES = 1_000_000

_made: list[list[DataFrame]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the session's part of the shared folder."""
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write an intermediate table (zstd Parquet) to the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    if _made:
        _made[-1].append(kept)
    return kept


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs run inside send whole texts (or larger rows) to Python at most ``rows`` at a time.

    The session's 10,000 texts of a few kilobytes are tens of megabytes, which a task holds in the JVM and again in its worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that :func:`keep` makes inside are deleted at the end; what outlives them must be kept outside or written inside another folder."""
    _made.append([])
    try:
        yield
    finally:
        for df in _made.pop():
            drop_kept(df)


def outlive(df: DataFrame) -> DataFrame:
    """Take a kept table out of the :func:`scratch` around it."""
    _made[-1] = [t for t in _made[-1] if t is not df]
    if len(_made) > 1:
        _made[-2].append(df)
    return df


def placed(docs: DataFrame) -> DataFrame:
    """``(row, place)``: whole rows as structs, with a bigint that names each row of its files for good.

    The place is made of the number of the file and the row's index in it, so a table that is a scan of Parquet files is read
    again instead of copied; anything else is written first.
    """
    def where(df: DataFrame):
        return df.metadataColumn("_metadata")

    try:
        docs.select(where(docs)["row_index"])
    except AnalysisException:
        docs = keep(docs, "rows")
    m = where(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), m["file_path"].alias("file"), m["row_index"].alias("at"))
    # one task numbers the names of the files, which are few beside their rows
    files = keep(rows.select("file").distinct().coalesce(1).select("file", F.monotonically_increasing_id().alias("number")), "files")
    few = files.count() <= BROADCAST_FILES
    both = rows.join(F.broadcast(files) if few else files, "file")
    return both.select("row", (F.shiftleft("number", 63 - FILE_BITS) + F.col("at")).alias("place"))


def drop_kept(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`keep` that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/chromaspark-{spark.sparkContext.applicationId}/" not in folder:
            raise ValueError(f"not an intermediate table of this session: {folder}")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def slices(texts: list, limit: int = BATCH_BYTES):
    """Runs of texts of about ``limit`` characters; one longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        n = len(t) if t else 0
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run
