"""Keeping intermediate tables: written to the shared folder, persisted, or size-checked."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the session's ``spark.checkpoint.dir``.

    Only a local-mode session (tests, laptops) gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    folder = folder or sc.getConf().get("spark.checkpoint.dir", None)
    if folder:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)
        return folder
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="chromaspark-")
    sc.setCheckpointDir(folder)
    return folder


def session_folder(spark: SparkSession) -> str:
    """This session's part of the shared folder; can be removed once the session has ended."""
    return f"{shared_folder(spark)}/chromaspark-{spark.sparkContext.applicationId}"


def keep(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    The result is a plain scan: later plans stay small, read only the columns they need and know the
    table's size, and a lost executor costs nothing but a re-read.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _made.get(threading.get_ident()):
        _made[threading.get_ident()][-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_made: dict[int, list[list[str]]] = {}  # by thread


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread keeps inside are deleted at the end, so a result must be written before."""
    scopes = _made.setdefault(threading.get_ident(), [])
    scopes.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in scopes.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def with_ids(df: DataFrame, name: str = "run_id") -> DataFrame:
    """``df`` with a unique bigint id a row, kept, so that the ids stay as they are."""
    return keep(df.withColumn(name, F.monotonically_increasing_id()))


def hot(df: DataFrame) -> DataFrame:
    """Persist a kept table that an iterative fit reads many times (spills to disk)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for plans that grow with every iteration."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_rows(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; never counts further than that."""
    return df.limit(limit + 1).count() <= limit


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Driver rows of a table that must be small (labels, axis stats); raises otherwise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, too many to hold on the driver")
    return rows
