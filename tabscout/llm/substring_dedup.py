"""Substring dedup: words under a window that an earlier document also has are removed.

Rabin-Karp hashes of every window of `window` words are counted in Spark, and repeated windows merge
into maximal removal intervals. A row for each window would move several times the input, so windows
travel in blobs, as in a radix sort:

1. Documents are dealt into batches by a hash of their id and text. A batch keeps each window hash once,
   with the smallest doc_id that has it there, and splits its hashes by range ("bucket") into one row each:
   the hashes and the delta-coded doc_ids.
2. With more than `FAN` buckets there are more levels: the rows of `FAN` batches for one range are merged,
   each hash again kept once with its smallest doc_id, and split by a finer range. So a row never gets
   small, and rows grow in proportion to the input.
3. A bucket sees all hashes of its range, finds the smallest doc_id of each, and answers every row that it
   got with one bit a hash: does a smaller doc_id have it? Answers go back the same way. A window is
   repeated if its hash is, or if a smaller doc_id of its own batch has it.
4. Each batch meets its bits, computes its windows anew in the same order, and cuts its texts.

Batches and buckets grow in number with the input, so a task's memory does not. A hot passage reaches
its bucket once for each batch at most (each group of batches, with more levels), however many documents have it.

Hashes: the first range comes from one 64-bit hash, the rest and the 7 bytes that are compared from another of
another base; with more than one level 10 bytes, 8 of the one and 2 of a third. Two different windows meet with a
probability under 2**-56 / buckets, or 2**-80 / FAN.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.llm import kernels as K
from tabscout.llm.shared import text_pieces

#: Input bytes of a batch and windows of a bucket aimed at: least and most.
BATCH_BYTES = (4 << 20, 32 << 20)
BUCKET_WINDOWS = (1 << 19, 1 << 22)
#: Batches and buckets aimed at, between these bounds.
PARTS = 192
#: Most buckets that one level splits rows into, and batches whose rows the next level merges.
FAN = 1024

OUT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"
ROWS, MASKS = "part long, key long, hashes binary, more binary, docs binary", "part long, key long, n int, bits binary"


def _planes(values: np.ndarray) -> bytes:
    """Byte planes of 64-bit values: those of small values are zeros, which compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _ordered(table: pa.Table) -> pa.Table:
    """The rows of a batch in an order that every run gives: by id (null last), then text."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _ids(table: pa.Table) -> np.ndarray:
    """Ids as numbers; null counts as larger than any."""
    return table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()


def _pieces(table: pa.Table, window: int, split: int, levels: int):
    """Each piece of a batch: its texts' range, bytes, word spans, window starts, and the windows' counts, range and hash."""
    for lo, hi, data, offsets in text_pieces(table.column("text")):
        starts, ends, first = K.spans(data, offsets, K.SOLID)
        words = K.span_hashes(data, starts, ends)
        at, counts = K.window_starts(first, window)
        other = K.window_hashes(words, at, window, K.WORD_BASE_2)
        hashes = K.window_hashes(words, at, window)
        if levels == 1:
            hashes &= np.uint64((1 << 56) - 1)
        more = (K.mixed(other) >> np.uint64(48)).astype(np.uint16) if levels > 1 else np.zeros(len(at), np.uint16)
        yield lo, hi, data, starts, ends, first, at, counts, (other % np.uint64(split)).astype(np.int64), hashes, more


class _Unique:
    """The distinct hashes of some windows, by range and smallest id, and which of them each window has."""

    def __init__(self, digit: np.ndarray, hashes: np.ndarray, more: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        h, x, d = hashes[order], more[order], digit[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(ids[order], first) if len(first) else ids
        place = np.lexsort((least, d[first]))
        rank = np.empty(len(first), np.int64)
        rank[place] = np.arange(len(first))
        self.entry = np.empty(len(h), np.int64)
        self.entry[order] = rank[np.cumsum(new) - 1]
        self.digit, self.hashes, self.more, self.least = d[first][place], h[first][place], x[first][place], least[place]

    def rows(self, part: int, prefix: int, split: int, levels: int) -> pa.Table:
        """A row for each range that has a hash."""
        edges = np.searchsorted(self.digit, np.arange(split + 1))
        full = np.flatnonzero(np.diff(edges))
        cuts = list(zip(edges[full].tolist(), edges[full + 1].tolist()))
        bare = self.hashes.view(np.uint8).reshape(-1, 8)[:, : 7 if levels == 1 else 8]
        blobs = [[bare[a:b].tobytes() for a, b in cuts], [self.more[a:b].tobytes() if levels > 1 else b"" for a, b in cuts], [_planes(np.diff(self.least[a:b], prepend=0)) for a, b in cuts]]
        return pa.table([pa.array(np.full(len(full), part), pa.int64()), pa.array(prefix * split + full, pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=["part", "key", "hashes", "more", "docs"])

    def repeated(self, masks: pa.Table, ids: np.ndarray) -> np.ndarray:
        """For each window, by the answers to rows(): does a smaller id have its hash, elsewhere or here?"""
        got = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(masks.sort_by("key").column("bits").to_pylist(), masks.sort_by("key").column("n").to_pylist())]
        flags = np.concatenate(got).astype(bool) if got else np.zeros(0, bool)
        return flags[self.entry] | (ids > self.least[self.entry])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, their other bytes and ids of all rows, end to end, and where the rows begin."""
    hashes, more, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for h, x, d in zip(*(table.column(c).to_pylist() for c in ("hashes", "more", "docs"))):
        ids = np.cumsum(_unplanes(d))
        padded = np.zeros((len(ids), 8), np.uint8)
        padded[:, : len(h) // len(ids)] = np.frombuffer(h, np.uint8).reshape(len(ids), -1)
        hashes.append(padded.view(np.uint64).ravel())
        more.append(np.frombuffer(x, np.uint16) if x else np.zeros(len(ids), np.uint16))
        docs.append(ids)
    return *(np.concatenate(x) for x in (hashes, more, docs)), np.cumsum([len(x) for x in docs])


def _answers(table: pa.Table, flags: np.ndarray, edges: np.ndarray) -> pa.Table:
    bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
    return pa.table([table.column("part"), table.column("key"), pa.array(np.diff(edges), pa.int32()), pa.array(bits, pa.binary())], names=["part", "key", "n", "bits"])


def _judge(table: pa.Table) -> pa.Table:
    """For a bucket: a bit for each hash of each row."""
    hashes, more, ids, edges = _unpacked(table)
    own = _Unique(np.zeros(len(ids), np.int64), hashes, more, ids)
    return _answers(table, ids > own.least[own.entry], edges)


def _windows(table: pa.Table, window: int, split: int, levels: int) -> tuple[_Unique, np.ndarray]:
    """The hashes of a batch, and the id of each window."""
    ids, parts = _ids(table), [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64))]
    for lo, hi, *_, counts, digit, hashes, more in _pieces(table, window, split, levels):
        parts.append((digit, hashes, more, np.repeat(ids[lo:hi], counts)))
    digit, hashes, more, docs = (np.concatenate(x) for x in zip(*parts))
    return _Unique(digit, hashes, more, docs), docs


def _emitter(window: int, split: int, levels: int):
    def emit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _windows(_ordered(table), window, split, levels)[0].rows(key[0].as_py(), 0, split, levels)

    return emit


def _merged(table: pa.Table, split: int, level: int) -> tuple[pa.Table, _Unique, np.ndarray, np.ndarray]:
    """The rows in order, their distinct hashes by the ranges of this level, the ids, and where the rows begin."""
    table = table.sort_by("part")
    hashes, more, ids, edges = _unpacked(table)
    digit = (hashes // np.uint64(split ** (level - 2)) % np.uint64(split)).astype(np.int64)
    return table, _Unique(digit, hashes, more, ids), ids, edges


def _merger(split: int, levels: int, level: int):
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _merged(table, split, level)[1].rows(key[0].as_py(), key[1].as_py(), split, levels)

    return merge


def _passer(split: int, level: int):
    def back(table: pa.Table, masks: pa.Table) -> pa.Table:
        table, own, ids, edges = _merged(table, split, level)
        return _answers(table, own.repeated(masks, ids), edges)

    return back


def _judged(rows: DataFrame, split: int, fan: int, levels: int, level: int = 1) -> DataFrame:
    """The answers to rows that are split by `level` ranges: by their buckets if these are all, else by a level more."""
    if level == levels:
        return rows.groupBy("key").applyInArrow(_judge, MASKS)
    grouped = rows.withColumn("group", F.floor(F.col("part") / fan))
    finer = grouped.groupBy("group", "key").applyInArrow(_merger(split, levels, level + 1), ROWS)
    masks = _judged(finer, split, fan, levels, level + 1).withColumn("range", F.floor(F.col("key") / split))
    return grouped.groupBy("group", "key").cogroup(masks.groupBy("part", "range")).applyInArrow(_passer(split, level + 1), MASKS)


def _cutter(window: int, split: int, levels: int):
    def cut(table: pa.Table, masks: pa.Table) -> pa.Table:
        table = _ordered(table)
        own, docs = _windows(table, window, split, levels)
        flags = own.repeated(masks, docs)
        n_words, n_removed, spans, n_spans, texts, done = [], [], [], [], [], 0
        for lo, hi, data, starts, ends, first, at, *_ in _pieces(table, window, split, levels):
            gone = K.covered(len(starts), at[flags[done : done + len(at)]], window)
            done += len(at)
            n_words.append(np.diff(first))
            n_removed.append(K.sums_by_text(gone, first))
            a, b = K.runs(gone, first)
            owner = np.searchsorted(first, a, side="right") - 1
            spans.append((a - first[owner], b - first[owner]))
            n_spans.append(np.bincount(owner, minlength=hi - lo))
            out, edges = K.joined(data, starts[~gone], ends[~gone])
            kept = edges[np.concatenate([[0], np.cumsum(n_words[-1] - n_removed[-1])])]
            texts += [out[x : y - 1].tobytes().decode() if y > x else "" for x, y in zip(kept[:-1].tolist(), kept[1:].tolist())]
        flat = [np.concatenate(x) for x in zip(*spans)]
        intervals = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], ["start", "end"])
        edges = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(n_spans))]), pa.int32())
        columns = [table.column("doc_id"), pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_removed), pa.int64()), pa.ListArray.from_arrays(edges, intervals), pa.array(texts, pa.string())]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    return cut


def _between(x: float, bounds: tuple[int, int]) -> int:
    return int(min(max(x, bounds[0]), bounds[1]))


def remove_repeated(
    docs: DataFrame, window: int = 13, id_column: str = "doc_id", text_column: str = "text", batch_bytes: tuple[int, int] = BATCH_BYTES, bucket_windows: tuple[int, int] = BUCKET_WINDOWS, fan: int = FAN
) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, removed, kept_text), one for each row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window over it has a word sequence that
    also starts in a row with a smaller id; windows are judged on the input. `removed` has the maximal
    intervals of removed words (end exclusive), `kept_text` the other words joined by one space.

    Nulls: a null text has no words; a null id counts as larger than any other. Texts under `window`
    words, or empty, keep all their words. Rows with one id are one document: neither is smaller. An
    empty table gives no rows. Other columns of `docs` are not read.

    batch_bytes and bucket_windows bound what a task holds: about 10 times a batch and 50 bytes a window. Rows alike
    in id and text are in one batch.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
    batches = max(1, -(-size // _between(size / PARTS, batch_bytes)))
    windows = size / 6 + 1
    buckets = max(1, int(-(-windows // _between(windows / PARTS, bucket_windows))))
    levels = max(1, math.ceil(math.log(buckets) / math.log(fan) - 1e-9))
    split = math.ceil(buckets ** (1 / levels) - 1e-9)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))
    blobs = dealt.groupBy("part").applyInArrow(_emitter(window, split, levels), ROWS)
    masks = _judged(blobs, split, fan, levels)
    return dealt.groupBy("part").cogroup(masks.groupBy("part")).applyInArrow(_cutter(window, split, levels), OUT)
