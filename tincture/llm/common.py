"""Shared plumbing of the training-data operators: session settings, shared-folder tables, byte and word arrays."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

U64 = np.uint64
_CHECKPOINT = "spark.checkpoint.dir"
#: Words are runs of bytes other than these (space and the five ASCII controls from tab to carriage return).
_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = False


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (as in tests) is a local folder made and set.
    """
    path = spark.conf.get(_CHECKPOINT, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"on a cluster {_CHECKPOINT} must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tincture-")
        spark.conf.set(_CHECKPOINT, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def tune(spark: SparkSession, rows: int = 512) -> None:
    """Bound the batches that go to Python workers, so that long texts do not add up in one batch."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


class Scratch:
    """Tables of one query in the shared folder. ``drop`` deletes those no longer needed.

    Tables are plain Parquet, so a lost executor loses nothing that a later stage reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self._forget)

    def save(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _forget(self) -> None:
        try:
            if self.spark._jsc is not None and not self.spark._jsc.sc().isStopped():
                self._delete(self.root)
        except Exception:  # the session is gone; its folder goes with it
            if self.root.startswith("file:"):
                import shutil

                shutil.rmtree(self.root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def text_bytes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", *extra: str) -> DataFrame:
    """(id, text as UTF-8 binary with null as empty, extra columns)."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *extra)


def free_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id written as text leaves ``remainder``; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def hash_bound(share: float) -> int:
    """The signed 64-bit bound below which a share of all hashes lies."""
    return min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, share)))


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column holds about ``most`` bytes in each (a longer row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.frombuffer(batch.column(column).buffers()[1], dtype=np.int32)[batch.column(column).offset :][: batch.num_rows + 1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, int(ends[first]) + most, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and each row's start (one more for the end)."""
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset :][: len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    if data is None or len(array) == 0:
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer, elementwise."""
    with np.errstate(over="ignore"):
        x = (x + U64(0x9E3779B97F4A7C15)).astype(U64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE_KEYS = splitmix(np.arange(256, dtype=U64) + U64(0xB17E))


def place_keys(n: int, salt: int = 0x5EED) -> np.ndarray:
    return splitmix(np.arange(n, dtype=U64) + U64(salt)) | U64(1)


def find_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in the bytes, and each row's first word (one more for the end); no word crosses rows."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD_BYTE[buf]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    borders = offsets[:-1][offsets[:-1] < len(buf)]
    opens[borders] = inside[borders]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    closes[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (multilinear, then mixed)."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(firsts, lengths)
    with np.errstate(over="ignore"):
        terms = _BYTE_KEYS[buf[at + np.repeat(starts, lengths)]] * place_keys(int(lengths.max()))[at]
        return splitmix(np.add.reduceat(terms, firsts) + lengths.astype(U64))


def window_hashes(items: np.ndarray, size: int, salt: int = 0xA11) -> np.ndarray:
    """Hash of each run of ``size`` items; shorter input gives none."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    keys = place_keys(size, salt)
    with np.errstate(over="ignore"):
        total = items[:n] * keys[0]
        for k in range(1, size):
            total += items[k : n + k] * keys[k]
    return splitmix(total)
