"""What the operators of this subpackage share: the folder all executors see, and Arrow glue."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel takes at once; a longer text is taken alone.
PIECE_BYTES = 1 << 19


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A folder of this machine, gone when the process ends."""
    folder = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset and all runs on this machine, a folder of it (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "local")
    if not folder and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or _own_folder()


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path of the shared folder, and the path in it, for tasks: any that Arrow can open (local, HDFS, S3, GCS)."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: the lineage ends there."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def within(df: DataFrame, rows: int) -> DataFrame:
    """`df`, to be broadcast if it has at most `rows` rows: counted now, so give a written table."""
    return F.broadcast(df) if df.count() <= rows else df


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and the len + 1 offsets of the texts in them. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts, in order, of at most `limit` bytes each (or of one text)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of each piece of a column."""
    data, offsets = text_bytes(column)
    for lo, hi in pieces(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def long_list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """list<long> with `counts` values a row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int64()))
