"""Token ids in Arrow stream files: equal-length sequences and masks that can be mapped and read in place.

A file is one Arrow stream of record batches with two fixed-size-list columns, ``ids`` and ``mask``
(true: a token, false: padding after the last one). All batches but the last have the same number of
sequences, so the place of a sequence follows from its number. Buffers are not compressed: mapping the
file and slicing a batch copies nothing. Ids take two bytes where the vocabulary allows it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from chromaspark.llm.common import new_folder
from chromaspark.llm.pieces import whole_text_encoder

SEQUENCE = 1024
SEQUENCES_PER_BATCH = 256
_INDEX = "part bigint, file string, doc_id bigint, first bigint, n_tokens bigint"


# Hadoop's scheme of a path: the one Arrow knows the same store by
_SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark itself resolves it: a bare path lies in the cluster's default file system.

    A store that Arrow cannot write to is an error here, before any task runs.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if whole.split(":", 1)[0] not in _SCHEMES:
        raise ValueError(f"token files cannot be written to {whole}; known schemes: {', '.join(_SCHEMES)}")
    return whole


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a qualified path, or of a bare one on this machine."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


class TokenWriter:
    """Writes a run of ids into one file, sequence after sequence."""

    def __init__(self, path: str, bytes_per_id: int, sequence: int = SEQUENCE, per_batch: int = SEQUENCES_PER_BATCH):
        store, name = _filesystem(path)
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.dtype, self.sequence, self.room = np.dtype(f"<u{bytes_per_id}"), sequence, sequence * per_batch
        item = {1: pa.uint8(), 2: pa.uint16(), 4: pa.uint32()}[bytes_per_id]
        self.schema = pa.schema([("ids", pa.list_(item, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.out = store.open_output_stream(name)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.held, self.n_held, self.count = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // self.dtype.itemsize
        self.count += len(ids) // self.dtype.itemsize
        if self.n_held >= self.room:
            whole = np.frombuffer(b"".join(self.held), self.dtype)
            full = len(whole) // self.room * self.room
            for at in range(0, full, self.room):
                self._batch(whole[at: at + self.room])
            self.held, self.n_held = [whole[full:].tobytes()], len(whole) - full

    def _batch(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.sequence) * self.sequence
        padded = np.zeros(n, dtype=self.dtype)
        padded[: len(ids)] = ids
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(padded), self.sequence),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(n) < len(ids)), self.sequence),
        ]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.held), self.dtype)
        if len(rest):
            self._batch(rest)
        self.stream.close()
        self.out.close()


class TokenFile:
    """Random access to a written file; a local file is mapped, and its sequences are views into the map."""

    def __init__(self, path: str):
        store, name = _filesystem(path)
        source = pa.memory_map(name) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(name)
        reader = pa.ipc.open_stream(source)
        self.sequence_length = reader.schema.field("ids").type.list_size
        self.batches = list(reader)
        self.per_batch = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _place(self, i: int) -> tuple[pa.RecordBatch, int]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return self.batches[i // self.per_batch], i % self.per_batch * self.sequence_length

    def sequence(self, i: int) -> np.ndarray:
        batch, at = self._place(i)
        return batch.column(0).flatten().to_numpy()[at: at + self.sequence_length]

    def mask(self, i: int) -> np.ndarray:
        batch, at = self._place(i)
        return batch.column(1).flatten()[at: at + self.sequence_length].to_numpy(zero_copy_only=False)

    @lru_cache(maxsize=4)
    def _values(self, batch: int) -> np.ndarray:
        return self.batches[batch].column(0).flatten().to_numpy()

    def tokens(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from place ``first`` of the file; a view unless they lie in several batches."""
        size, parts = self.per_batch * self.sequence_length, []
        while count > 0:
            values = self._values(first // size)[first % size: first % size + count]
            if not len(values):
                raise IndexError("past the end of the file")
            parts.append(values)
            first, count = first + len(values), count - len(values)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text",
    sequence: int = SEQUENCE, per_batch: int = SEQUENCES_PER_BATCH, bytes_per_id: int = 2,
) -> str:
    """Encode ``docs`` into token files below ``folder`` (default: a new one in the shared folder), which is returned with its scheme.

    Files hold the documents in ascending key order (null keys first; rows with equal keys by a hash of the
    text), each followed by ``end_id``; a null or empty text is its end id alone. ``folder/index`` is a
    Parquet table with a row per document: part, file, key (``doc_id``), first place in the file, number of
    ids. A file gets its name from the attempt that wrote it, and the index lists those of successful
    attempts, so a repeated task leaves no trace in the data. Repeated rows are written as often as given;
    no rows make an index without rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or new_folder(spark, "tokens"))
    rows = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mix"),
        F.monotonically_increasing_id().alias("place"),
    )
    # the last two keys split any number of rows with one doc_id over several files
    dealt = rows.repartitionByRange("doc_id", "mix", "place").sortWithinPartitions("doc_id", "mix", "place")
    parts = dealt.select("doc_id", "text", F.spark_partition_id().cast("bigint").alias("part"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, out, path = whole_text_encoder(tokenizer_path, bytes_per_id).encode, end_id.to_bytes(bytes_per_id, "little"), None, None
        for b in batches:
            first, size, keys, parts = [], [], b.column(0), b.column(2)
            for t in b.column(1):
                if out is None:
                    path = f"{folder}/data/{parts[0].as_py():06d}-{uuid.uuid4().hex}.arrow"
                    out = TokenWriter(path, bytes_per_id, sequence, per_batch)
                first.append(out.count)
                out.add(encode(t.as_py()) + end)
                size.append(out.count - first[-1])
            n = len(first)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [parts, pa.array([path] * n, pa.string()), keys, pa.array(first, pa.int64()), pa.array(size, pa.int64())],
                    ["part", "file", "doc_id", "first", "n_tokens"],
                )
        if out is not None:
            out.close()

    parts.mapInArrow(write, _INDEX).write.parquet(f"{folder}/index")
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files of :func:`write_token_files`.

    ``start`` counts the ids of all documents before it; the checksum is taken over the ids as
    little-endian unsigned 32-bit integers. One row per file passes through the driver.
    """
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    sizes = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, before = {}, 0
    for r in sizes:
        starts[r["file"]] = before
        before += r["n"]

    def read(group: pa.Table) -> pa.Table:
        path = group.column("file")[0].as_py()
        data, start = TokenFile(path), starts[path]
        first, count = group.column("first").to_numpy(), group.column("n_tokens").to_numpy()
        crc = [zlib.crc32(data.tokens(a, n).astype("<u4").tobytes()) for a, n in zip(first.tolist(), count.tolist())]
        return pa.table({
            "doc_id": group.column("doc_id"), "start": pa.array(first + start), "n_tokens": pa.array(count),
            "ids_crc32": pa.array(crc, pa.int64()),
        })

    return index.groupBy("file").applyInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
