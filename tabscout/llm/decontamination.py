"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every word sequence of every item. A document's words are streamed through it and
the length of the longest match that ends at each word is tracked: where that reaches `window` words, a
window of an item occurs. Items of fewer words are windows as a whole.

Only words of the items can keep a match alive, so each task first finds, in numpy, the runs of words
that items have; the automaton sees those runs that are long enough to hold a window. Any other word
sets it back to its start, as no item has it.

Items are written to the shared folder in shards of about `SHARD_BYTES` of text, and each worker builds a
shard's automaton from there: about 400 bytes a word, so some 250 MB for a shard. One shard marks and
judges a document in one pass. With more, each shard marks documents in a pass of its own over a written table, and
what comes back is the marks, which meet the documents before anything is judged or cut.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.llm import kernels as K
from tabscout.llm.shared import filesystem, shared_path, text_pieces, written

#: Bytes of item texts of one automaton: what a worker holds at once. An item is not split.
SHARD_BYTES = 4 << 20

SPANS = "array<struct<start:long,end:long>>"
FOUND = f"doc_id long, n_words long, n_hit long, items array<string>, hits {SPANS}"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class SuffixAutomaton:
    """Of all items' word sequences. Words are numbers from 0; transitions are one table by state and word."""

    def __init__(self, items: list[list[int]], window: int) -> None:
        self.window, self.width = window, max((max(x) for x in items if x), default=0) + 1
        self.link, self.length = array("q", [-1]), array("q", [0])
        self.next: dict[int, int] = {}
        #: For copies of a state: its words, as a list through `_earlier`.
        self._last, self._word, self._earlier = array("q", [-1]), array("q"), array("q")
        for words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        del self._last, self._word, self._earlier
        #: Items of the states that hold a window's sequence, a number or a list; short items end with a state's matches: (words, item).
        self.items: dict[int, int | list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for number, words in enumerate(items):
            state = 0
            for i, w in enumerate(words, 1):
                state = self.next[state * self.width + w]
                if i >= window:
                    at = self._holding(state, window)
                    own = self.items.setdefault(at, number)
                    if isinstance(own, list):
                        own.extend([number] if own[-1] != number else ())  # numbers ascend
                    elif own != number:
                        self.items[at] = [own, number]
            if 0 < len(words) < window:
                self.short.setdefault(self._holding(state, len(words)), []).append((len(words), number))

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._last.append(-1)
        return len(self.length) - 1

    def _arrow(self, state: int, w: int, target: int) -> None:
        self.next[state * self.width + w] = target
        self._word.append(w)
        self._earlier.append(self._last[state])
        self._last[state] = len(self._word) - 1

    def _holding(self, state: int, n: int) -> int:
        """The state of the suffix of n words of a state's sequences."""
        while self.link[state] >= 0 and self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _clone(self, p: int, q: int, w: int) -> int:
        """A state for the sequence of p and w, split off q."""
        new = self._state(self.length[p] + 1, self.link[q])
        at = self._last[q]
        while at >= 0:
            self._arrow(new, self._word[at], self.next[q * self.width + self._word[at]])
            at = self._earlier[at]
        self.link[q] = new
        while p >= 0 and self.next.get(p * self.width + w) == q:
            self.next[p * self.width + w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: int) -> int:
        """The state after word w of an item whose earlier words led to `last`."""
        there = self.next.get(last * self.width + w)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, there, w)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and p * self.width + w not in self.next:
            self._arrow(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self.next[p * self.width + w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, Sequence[int]]]:
        """(end, words, items) of each occurrence of a window; words are of one document, in order."""
        state, n = 0, 0
        for i, w in enumerate(words):
            there = self.next.get(state * self.width + w)
            while there is None and state:
                state = self.link[state]
                n = self.length[state]
                there = self.next.get(state * self.width + w)
            if there is None:
                continue
            state, n = there, n + 1
            if n >= self.window:
                found = self.items[self._holding(state, self.window)]
                yield i + 1, self.window, found if isinstance(found, list) else (found,)
            if self.short:
                at = state
                while at > 0:
                    for size, number in self.short.get(at, ()):
                        if size <= n:
                            yield i + 1, size, (number,)
                    at = self.link[at]


class _Index:
    """The automaton of a shard and the sorted hashes of its words."""

    def __init__(self, ids: list[str | None], texts: pa.ChunkedArray, window: int) -> None:
        hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in text_pieces(texts):
            h, first = word_hashes(data, offsets)[2:]
            hashes.append(h)
            sizes.append(np.diff(first))
        edges = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.vocabulary, number = np.unique(np.concatenate(hashes), return_inverse=True)
        number = number.tolist()
        sequences = [number[a:b] for a, b in zip(edges[:-1], edges[1:])]
        self.ids = ids
        self.automaton = SuffixAutomaton(sequences, window)
        self.shortest = min((min(len(s), window) for s in sequences if s), default=0)


class _Shard:
    """One part of the items, in the shared folder; a worker holds the index that it used last."""

    _built: dict[tuple, _Index] = {}

    def __init__(self, path: str, number: int, window: int) -> None:
        self.key = (path, number, window)

    def index(self) -> _Index:
        if self.key not in _Shard._built:
            _Shard._built.clear()
            files, root = filesystem(self.key[0])
            folder = f"{root}/shard={self.key[1]}"
            found = files.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True))
            tables = [pa.parquet.read_table(x.path, filesystem=files, columns=["item", "text"], partitioning=None) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".parquet")]
            items = pa.concat_tables(tables).sort_by([("item", "ascending"), ("text", "ascending")]) if tables else pa.table({"item": pa.array([], pa.string()), "text": pa.array([], pa.string())})
            _Shard._built[self.key] = _Index(items.column("item").to_pylist(), items.column("text"), self.key[2])
        return _Shard._built[self.key]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends, hashes of the normalised words, and the first word of each text."""
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offsets, K.ALNUM)
    return starts, ends, K.span_hashes(data, starts, ends), first


def _hits(index: _Index, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Which words are in a window's occurrence, and the items of each text that has any."""
    hit = np.zeros(len(hashes), bool)
    items: dict[int, set[int]] = {}
    if not len(index.vocabulary) or not len(hashes):
        return hit, items
    number = np.searchsorted(index.vocabulary, hashes)
    number[number == len(index.vocabulary)] = 0
    known = index.vocabulary[number] == hashes
    begin, end = K.runs(known, first)
    long = np.flatnonzero(end - begin >= index.shortest)
    owner = np.searchsorted(first, begin[long], side="right") - 1
    for text, a, b in zip(owner.tolist(), begin[long].tolist(), end[long].tolist()):
        for stop, size, found in index.automaton.matches(number[a:b].tolist()):
            hit[a + stop - size : a + stop] = True
            items.setdefault(text, set()).update(found)
    return hit, items


def _spans(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends, in words of their text, of the maximal runs, and how many each text has."""
    begin, end = K.runs(mask, first)
    owner = np.searchsorted(first, begin, side="right") - 1
    return begin - first[owner], end - first[owner], np.bincount(owner, minlength=len(first) - 1)


def _marker(shard: _Shard):
    """Rows (row, items, hits) of the texts that a shard hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shard.index()
        for batch in batches:
            rows, named, marked = [], [], []
            for lo, _, data, offsets in text_pieces(batch.column(1)):
                _, _, hashes, first = word_hashes(data, offsets)
                hit, found = _hits(index, hashes, first)
                start, end, counts = _spans(hit, first)
                edges = np.concatenate([[0], np.cumsum(counts)])
                for k in np.flatnonzero(counts).tolist():
                    at = slice(edges[k], edges[k + 1])
                    rows.append(batch.column(0)[lo + k].as_py())
                    named.append(sorted({index.ids[x] for x in found[k] if index.ids[x] is not None}))
                    marked.append([{"start": x, "end": y} for x, y in zip(start[at].tolist(), end[at].tolist())])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(marked, _SPANS)], names=["row", "items", "hits"])

    return run


def _finisher(shard: _Shard | None, at: int, finish: Callable[..., pa.RecordBatch]):
    """finish(batch without the marks, text pieces with their hits, items of each text), the hits being of the one shard or of the marks in the last two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shard.index() if shard else None
        for batch in batches:
            names, marks = ([set() for _ in range(batch.num_rows)], None) if index else ([set(x or ()) for x in batch.column(batch.num_columns - 2).to_pylist()], batch.column(batch.num_columns - 1).to_pylist())
            parts = []
            for lo, hi, data, offsets in text_pieces(batch.column(at)):
                starts, ends, hashes, first = word_hashes(data, offsets)
                if index:
                    hit, found = _hits(index, hashes, first)
                    for k, items in found.items():
                        names[lo + k] = {index.ids[x] for x in items if index.ids[x] is not None}
                else:
                    hit = np.zeros(len(hashes), bool)
                    for k in range(lo, hi):
                        for span in marks[k] or ():
                            hit[first[k - lo] + span["start"] : first[k - lo] + span["end"]] = True
                parts.append((lo, hi, data, offsets, starts, ends, first, hit))
            if parts:
                own = batch if index else batch.select(list(range(batch.num_columns - 2)))
                yield finish(own, parts, names)

    return run


def _measured(batch: pa.RecordBatch, parts: list[tuple], names: list[set[str]]) -> pa.RecordBatch:
    """Rows of FOUND, from doc_id and text."""
    n_words, n_hit, starts, ends, counts = zip(*((np.diff(first), K.sums_by_text(hit, first), *_spans(hit, first)) for *_, first, hit in parts))
    edges = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), pa.int32())
    spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (starts, ends)], ["start", "end"])
    items = pa.array([sorted(x) for x in names], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x), pa.int64()) for x in (n_words, n_hit)), items, pa.ListArray.from_arrays(edges, spans)], names=["doc_id", "n_words", "n_hit", "items", "hits"])


def _cutter(at: int, most: float):
    """The batch without the rows of which more than that share of the words is hit, and with the hit spans cut out of the texts of the others."""

    def cut(batch: pa.RecordBatch, parts: list[tuple], names: list[set[str]]) -> pa.RecordBatch:
        column, texts, stays = batch.column(at), [], []
        for lo, hi, data, offsets, starts, ends, first, hit in parts:
            hits = K.sums_by_text(hit, first)
            stays.append(hits <= most * np.diff(first))
            own = column.slice(lo, hi - lo)
            if hits.any():
                begin, end = K.runs(hit, first)
                gone = np.zeros(len(data) + 1, np.int64)
                gone[starts[begin]] += 1
                gone[ends[end - 1]] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                out = own.to_pylist()
                for k in np.flatnonzero(hits).tolist():
                    a, b = offsets[k], offsets[k + 1]
                    out[k] = data[a:b][keep[a:b]].tobytes().decode()
                own = pa.array(out, own.type)
            texts.append(own)
        columns = list(batch.columns)
        columns[at] = pa.concat_arrays([x.cast(column.type) for x in texts])
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(np.concatenate(stays)))

    return cut


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _judged(rows: DataFrame, benchmark: DataFrame, window: int, id_column: str, item_text_column: str, text_column: str, finish: Callable[..., pa.RecordBatch], schema) -> DataFrame:
    """finish() over all rows, with the hits of all items."""
    spark, at = rows.sparkSession, rows.columns.index(text_column)
    items = benchmark.select(F.col(id_column).cast("string").alias("item"), F.coalesce(F.col(item_text_column).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards, path = max(1, math.ceil(size / SHARD_BYTES)), shared_path(spark, "items")
    items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards))).repartition(min(shards, 512), "shard").write.partitionBy("shard").parquet(path)
    if shards == 1:
        return rows.mapInArrow(_finisher(_Shard(path, 0, window), at, finish), schema)
    name, items_name, hits_name = (_free(x, rows.columns) for x in ("row", "marked_items", "marked_hits"))
    rows = written(rows.withColumn(name, F.monotonically_increasing_id()), "rows")
    marks = None
    for k in range(shards):
        own = written(rows.select(name, text_column).mapInArrow(_marker(_Shard(path, k, window)), f"row long, items array<string>, hits {SPANS}"), "marks")
        marks = own if marks is None else marks.unionByName(own)
    marks = marks.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias(items_name), F.flatten(F.collect_list("hits")).alias(hits_name))
    joined = rows.join(marks, rows[name] == marks["row"], "left").select(*(rows[c] for c in rows.columns if c != name), marks[items_name], marks[hits_name])
    return joined.mapInArrow(_finisher(None, at, finish), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_hit, items, hits), one for each row of `docs`.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of texts lower-cased in A-Z. A word is hit if it is in
    an occurrence of `window` consecutive words of an item, or of a whole item of fewer words. `items`
    has the ids, as strings and sorted, of the items with an occurrence; `hits` the maximal runs of hit
    words (numbers in the document, end exclusive).

    Nulls: a null text has no words; an item without an id counts for hits but is not listed. Items
    without words are nothing; repeated items are listed once. An empty table of documents gives no
    rows, an empty benchmark no hits. Other columns are not read. How items are dealt into shards changes nothing.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return _judged(rows, benchmark, window, item_column, item_text_column, "text", _measured, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_coverage: float = 0.5, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """`docs`, all columns whatever their names, with the spans of hit words cut out of the texts (see contamination()).

    A span reaches from the first to the last character of a maximal run of hit words. A document of
    which more than `most_coverage` of the words are hit is dropped. Texts without a hit, null and
    empty ones stay as they are; repeated rows are each judged, an empty table gives no rows. Hits of all items
    count together, whatever shards they are dealt into.
    """
    return _judged(docs, benchmark, window, item_column, item_text_column, text_column, _cutter(docs.columns.index(text_column), most_coverage), docs.schema)
