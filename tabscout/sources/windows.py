"""Bounded reads of files: a Python data source with one partition for some files, two small reads each.

The middle of a file is never read, which binaryFile cannot do. Paths of this machine or a mounted store
are opened as they are; other schemes go through an opener, a callable uri -> binary file that the option
`opener` names as "module:function". HDFS, S3 and GCS are listed by Spark and read by range through Arrow;
stores that only Spark opens are read whole, by binaryFile.
"""

from __future__ import annotations

import glob
import importlib
import os
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabscout import constants as C
from tabscout.errors import FileSampleReadError
from tabscout.operators.sampling import check_budget, windows_of

SCHEMA = "path string, size long, head binary, tail binary, read_error string"
FILES_A_TASK = 64
#: Schemes of stores that Arrow opens.
ARROW_SCHEMES = ("hdfs", "s3", "s3a", "s3n", "gs")


def read_exactly(stream: Any, n: int) -> bytes:
    """n bytes, or fewer at the end; short reads go on. None is no end but an error, a str a TypeError."""
    out = bytearray()
    while len(out) < n:
        chunk = stream.read(min(n - len(out), C.STREAM_CHUNK_BYTES))
        if chunk is None:
            raise BlockingIOError("the stream has no data yet")
        if isinstance(chunk, str):
            raise TypeError("a binary stream is needed, not a text stream")
        if not chunk:
            break
        out += chunk
    return bytes(out)


def seekable(stream: Any) -> bool:
    test = getattr(stream, "seekable", None)
    try:
        return bool(test()) if callable(test) else hasattr(stream, "seek") and hasattr(stream, "tell")
    except (OSError, ValueError):
        return False


def stream_windows(stream: Any, head_bytes: int = C.DEFAULT_HEAD_BYTES, tail_bytes: int = C.DEFAULT_TAIL_BYTES, scan_limit: int = C.MAX_FORWARD_SCAN_BYTES) -> tuple[bytes, bytes | None, int | None]:
    """(head, tail, size) of a stream. A seekable one is read from its position, which is put back.

    Another is read once, keeping tail_bytes; past `scan_limit` its tail is None. Its size is None unless
    its end was reached.
    """
    if seekable(stream):
        start = stream.tell()
        try:
            end = stream.seek(0, os.SEEK_END)
            size = max(end - start, 0)
            stream.seek(start)
            head = read_exactly(stream, head_bytes)
            window = min(tail_bytes, max(size - len(head), 0))
            stream.seek(end - window)
            return head, read_exactly(stream, window) if window else b"", size
        finally:
            stream.seek(start)
    head = read_exactly(stream, head_bytes)
    if len(head) < head_bytes:
        return head, b"", len(head)
    if not tail_bytes:
        return head, b"", None
    tail, seen = b"", 0
    while chunk := read_exactly(stream, C.STREAM_CHUNK_BYTES):
        seen += len(chunk)
        if seen > scan_limit:
            return head, None, None
        tail = (tail + chunk)[-tail_bytes:]
    return head, tail, len(head) + seen if seen else None


def check_object_uri(uri: str) -> str:
    if not re.fullmatch(C.OBJECT_URI, uri):
        raise ValueError(f"not an object's URI: {uri!r}")
    return uri


def range_chunk(head_bytes: int, tail_bytes: int) -> int:
    """Bytes of a ranged request: the larger window, in whole steps of RANGE_CHUNK_BYTES."""
    return -(-max(head_bytes, tail_bytes, 1) // C.RANGE_CHUNK_BYTES) * C.RANGE_CHUNK_BYTES


def _opener(name: str | None) -> Any:
    if not name:
        return lambda path: open(path.removeprefix("file:"), "rb")
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.head, self.tail = int(options["headbytes"]), int(options["tailbytes"])
        self.opener, self.pattern, self.offset = options.get("opener"), options["path"], int(options.get("offset", 0))

    def partitions(self) -> list[InputPartition]:
        paths = [self.pattern] if self.opener else sorted(p for p in glob.glob(self.pattern.removeprefix("file:"), recursive=True) if os.path.isfile(p))
        return [_Files(paths[k : k + FILES_A_TASK]) for k in range(0, len(paths), FILES_A_TASK)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        opened = _opener(self.opener)
        for path in partition.paths:
            try:
                with opened(path) as f:
                    f.seek(self.offset)
                    head, tail, size = stream_windows(f, self.head, self.tail)
                yield path, size, head, tail, None
            except OSError as error:
                yield path, None, None, None, f"unable to read {path!r}: {error}"


class WindowsSource(DataSource):
    """format("tabscout_windows"): rows (path, size, head, tail, read_error), one a file."""

    @classmethod
    def name(cls) -> str:
        return "tabscout_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def _ranged(head_bytes: int, tail_bytes: int, offset: int):
    """Windows of listed files (path, length), by two ranged reads each."""
    names = ["path", "size", "head", "tail", "read_error"]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    files, name = pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
                    with files.open_input_file(name) as f:
                        f.seek(offset)
                        head, tail, size = stream_windows(f, head_bytes, tail_bytes)
                    rows.append((path, size, head, tail, None))
                except OSError as error:
                    rows.append((path, None, None, None, f"unable to read {path!r}: {error}"))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    return run


def listed(spark: SparkSession, path: str, head_bytes: int, tail_bytes: int, offset: int = 0) -> DataFrame:
    """The same rows of a file, folder or glob in a store that Arrow opens. Spark lists a folder or glob, without the contents and without empty files."""
    one = None if glob.has_magic(path) else pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    if one and one[0].get_file_info(one[1]).is_file:
        found = spark.createDataFrame([(path,)], "path string")
    else:
        found = spark.read.format("binaryFile").load(path).select("path", "length")
    return found.mapInArrow(_ranged(head_bytes, tail_bytes, offset), SCHEMA)


def read(spark: SparkSession, path: str, head_bytes: int = C.DEFAULT_HEAD_BYTES, tail_bytes: int = C.DEFAULT_TAIL_BYTES, opener: str | None = None, offset: int = 0) -> DataFrame:
    """Windows of the files at a path, folder or glob."""
    check_budget("head_bytes", head_bytes, 1)
    check_budget("tail_bytes", tail_bytes, 0)
    if re.match(r"[a-z][a-z0-9+.-]+://", path) and not path.startswith("file:") and not opener:
        if path.split(":")[0] in ARROW_SCHEMES:
            return listed(spark, path, head_bytes, tail_bytes, offset)
        whole = spark.read.format("binaryFile").load(path).select("path", "content")
        return windows_of(whole, "content", head_bytes, tail_bytes).drop("content").withColumn("read_error", F.lit(None).cast("string"))
    bare = path.removeprefix("file://").removeprefix("file:")
    if not opener and os.path.isdir(bare):
        path = os.path.join(bare, "**")
    elif not opener and not glob.has_magic(bare) and not os.path.exists(bare):
        raise FileSampleReadError(f"no file at {path!r}")
    spark.dataSource.register(WindowsSource)
    options = {"headBytes": str(head_bytes), "tailBytes": str(tail_bytes), "offset": str(offset)} | ({"opener": opener} if opener else {})
    return spark.read.format("tabscout_windows").options(**options).load(path)
