"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is frames end to end and a skippable
frame with the seek table (compressed and plain size of each frame), as in the public seekable format.
An index maps each record's identifier to its file, its frame's place in it, and its offset in the frame's plain
bytes, so one record costs one ranged read of one small frame.

Bundles are .warc.zst files in a folder that all executors reach, written by the tasks, a frame at a time. A
file has a name of its own and is named in the index only when it is whole: what a lost task leaves
behind is in no index, and its records are written anew.

Of records with equal payloads of at least `SMALLEST` bytes the one with the smallest id is a response,
and the others are revisits that refer to it and carry no payload.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.llm.shared import filesystem, shared_path, within, written

#: Plain bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME, BUNDLE = 256 << 10, 8 << 20
#: Rows up to which the digests of repeated payloads are broadcast; beyond, payloads are shuffled by digest.
MOST_BROADCAST = 100_000
#: Fewest bytes of a payload that revisits may refer to.
SMALLEST = 100
LEVEL = 3
#: Of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
#: Of this archive: when its records were written. A fixed date, so that reruns give equal bytes.
DATE = "2020-01-01T00:00:00Z"

INDEX = "record_id string, path string, frame_start long, frame_bytes long, offset long, length long"
RECORDS = "record_id string, uri string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def record(record_id: str, uri: str, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """A response record with its payload, or a revisit record without."""
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{_quoted(record_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_quoted(uri)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{_quoted(refers_to)}>"]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _quoted(text: str) -> str:
    """Without what would end a header's value: %, controls and <>, as %XX."""
    return "".join(f"%{ord(c):02X}" if c in "%<>" or ord(c) < 0x21 or ord(c) == 0x7F else c for c in text)


def _unquoted(text: str) -> str:
    head, *rest = text.split("%")
    return head + "".join(chr(int(x[:2], 16)) + x[2:] for x in rest)


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at byte {at}")
    headers = dict(x.split(": ", 1) for x in lines)
    start, length = end + 4, int(headers["Content-Length"])
    if data[start + length : start + length + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} does not end where its length says")
    return headers, data[start : start + length], start + length + 4


class BundleWriter:
    """Writes records to a file, a frame at a time; close() gives the index, and the bytes if no file was given."""

    def __init__(self, sink: Any = None) -> None:
        self.sink = io.BytesIO() if sink is None else sink
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.records: list[dict] = []
        self.open = bytearray()
        self.written = 0

    def add(self, record_id: str, data: bytes) -> None:
        self.records.append({"record_id": record_id, "frame": len(self.sizes), "offset": len(self.open), "length": len(data)})
        self.open += data
        if len(self.open) >= FRAME:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            frame = self.compressor.compress(bytes(self.open))
            self.sink.write(frame)
            self.sizes.append((len(frame), len(self.open)))
            self.written += len(frame)
            self.open = bytearray()

    def close(self) -> tuple[list[int], bytes | None, list[dict]]:
        """Where the frames begin, the bytes, and the records."""
        self._close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        starts = [0]
        for packed, _ in self.sizes:
            starts.append(starts[-1] + packed)
        content = self.sink.getvalue() if isinstance(self.sink, io.BytesIO) else None
        return starts, content, self.records


class BundleReader:
    """Reads a bundle, as bytes or an open file, by its seek table; a frame is read and decompressed when it is first asked for."""

    def __init__(self, source: Any) -> None:
        self.source = io.BytesIO(source) if isinstance(source, bytes) else source
        size = self.source.seek(0, 2)
        size = self.source.tell() if size is None else size
        n, flags, magic = struct.unpack("<IBI", self._range(size - 9, 9))
        if magic != FOOTER:
            raise ValueError("no seek table at the end")
        entry = 12 if flags & 0x80 else 8
        table, self.frames, start = self._range(size - 9 - n * entry, n * entry), [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, k * entry)
            self.frames.append((start, packed, plain))
            start += packed
        self._last: tuple[int, bytes] = (-1, b"")

    def _range(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            start, packed, plain = self.frames[k]
            self._last = (k, zstandard.ZstdDecompressor().decompress(self._range(start, packed), max_output_size=plain))
        return self._last[1]

    def read(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        headers, block, _ = parsed(self.frame(frame), offset)
        return headers, block

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                headers, block, at = parsed(data, at)
                yield headers, block


def _writer(folder: str):
    """Writes the rows of each task to bundles in the folder; rows of INDEX."""

    def indexed(path: str, writer: BundleWriter) -> pa.RecordBatch:
        starts, _, records = writer.close()
        rows = [(r["record_id"], path, starts[r["frame"]], starts[r["frame"] + 1] - starts[r["frame"]], r["offset"], r["length"]) for r in records]
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        sink = writer = path = None
        for batch in batches:
            for record_id, uri, size, digest, refers_to, payload in zip(*(batch.column(c) for c in ("record_id", "uri", "size", "digest", "refers_to", "payload"))):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    files.create_dir(root, recursive=True)
                    path, sink = f"{folder}/{name}", files.open_output_stream(f"{root}/{name}", compression=None)  # not once more for the name
                    writer = BundleWriter(sink)
                name = record_id.as_py()
                writer.add(name, record(name, uri.as_py(), payload.as_py(), size.as_py(), digest.as_py(), refers_to.as_py()))
                if writer.written >= BUNDLE:
                    out = indexed(path, writer)
                    sink.close()
                    writer = None
                    yield out
        if writer is not None:
            out = indexed(path, writer)
            sink.close()
            yield out

    return run


def bundles(pages: DataFrame, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html", folder: str | None = None) -> DataFrame:
    """Writes the archives of all rows of `pages` now, as .warc.zst files in the folder; rows of INDEX, one for each record.

    folder: one that all executors reach and Arrow can open; by default a new one in the shared folder.
    A null payload or uri is empty. A null id is the id "null". Of rows with equal ids and payloads the
    one that is written refers to itself by id: it is a response each time, so none refers to itself.
    Empty and small payloads are all responses. An empty table gives no file and no row. Other columns are not read.
    """
    folder = (folder or shared_path(pages.sparkSession, "bundles")).rstrip("/")
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(uri_column).cast("string"), F.lit("")).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("size") >= SMALLEST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(within(written(first, "repeated"), MOST_BROADCAST), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    out = rows.select(name.alias("record_id"), "uri", "size", "digest", F.when(revisit, F.col("first").cast("string")).alias("refers_to"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))
    return written(out.mapInArrow(_writer(folder), INDEX), "index")


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind, size, digest = headers["WARC-Type"], int(headers["WARC-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is not the one that was written")
    refers = headers.get("WARC-Refers-To")
    return _name(headers["WARC-Record-ID"]), _unquoted(headers["WARC-Target-URI"]), size, digest, kind, refers and _name(refers), block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, name = filesystem(path)
            with files.open_input_file(name) as source:
                rows, size = [], 0
                for headers, block in BundleReader(source):
                    rows.append(_row(headers, block))
                    size += len(block)
                    if len(rows) >= 512 or size >= BUNDLE:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])


def _name(value: str) -> str:
    return _unquoted(value.removeprefix("<urn:record:").removesuffix(">"))


def records(index: DataFrame) -> DataFrame:
    """Rows (record_id, uri, payload_bytes, payload_digest, record_type, refers_to, payload) of all files of an index, read by their seek tables."""
    return index.select("path").distinct().mapInArrow(_read, RECORDS)


def lookup(index: DataFrame, ids: list[str]) -> DataFrame:
    """The same rows for some record ids only, one for each row of the index that has them: of each file only the record's frame is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, size, offset in zip(*(batch.column(c).to_pylist() for c in ("path", "frame_start", "frame_bytes", "offset"))):
                files, name = filesystem(path)
                with files.open_input_file(name) as source:
                    source.seek(start)
                    frame = zstandard.ZstdDecompressor().decompress(source.read(size))
                headers, block, _ = parsed(frame, offset)
                yield _batch([_row(headers, block)])

    return index.where(F.col("record_id").isin(ids)).select("path", "frame_start", "frame_bytes", "offset").mapInArrow(run, RECORDS)
