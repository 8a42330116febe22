"""Quality rules: per-document limits, and lines that too many documents of one host have.

Normalised lines are hashed, distinct documents are counted for each line and host, lines above the
limit are removed, and documents that little is left of are rejected. Exact copies of one text count
as one document here, as copies are for the dedup operators to judge. A line is above the limit if
more than `most_documents` texts of its host and more than `most_share` of them have it.

A document gives one row for each distinct line, counted with map-side partial sums, so a line that
all documents have is a few rows for each task and not one large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.llm import kernels as K
from tabscout.llm.shared import text_pieces, within, written
from tabscout.llm.statistics import TextCounts

#: Fewest words of a document, and most of its words, in percent, in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A line is boilerplate of its host above both of these.
MOST_DOCUMENTS, MOST_SHARE = 20, 0.01
#: A document is depleted with under this share of its words left, or under so many words.
LEAST_LEFT, LEAST_WORDS_LEFT = 0.3, 30
#: Rows up to which the lines above the limit are broadcast; beyond, they are joined by shuffle.
MOST_BROADCAST = 100_000
#: Symbols for each character of words above which a text is markup or noise.
MOST_SYMBOLS = 0.1
#: Share of repeated lines above which a text is a list of the same.
MOST_DUPLICATE_LINES = 0.5

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
LINES = "lines array<struct<line:long,words:long>>"


def normalised(data: np.ndarray) -> np.ndarray:
    """Texts as lines are compared: a-z for A-Z and 0 for each digit."""
    out = K.LOWER[data]
    out[(out >= 0x30) & (out <= 0x39)] = 0x30
    return out


def line_hashes(counts: TextCounts) -> np.ndarray:
    """A hash of each line's normalised words, whatever white space stands between and around them."""
    words = K.span_hashes(normalised(counts.data), counts.starts, counts.ends)
    at = np.searchsorted(counts.starts, counts.line_starts)
    return K.sequence_hashes(words, at, at + counts.line_words)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts: list[list[np.ndarray]] = []
        for _, _, data, offsets in text_pieces(batch.column(2)):
            c = TextCounts(data, offsets)
            whole = K.span_hashes(data, offsets[:-1], offsets[1:])
            parts.append([c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.n_lines, whole, line_hashes(c), c.line_words])
        if not parts:
            continue
        *base, whole, line, words = (np.concatenate(x) for x in zip(*parts))
        edges = pa.array(np.concatenate([[0], np.cumsum(base[5])]), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(line.view(np.int64)), pa.array(words, pa.int64())], ["line", "words"])
        names = ["doc_id", "host", *(x.split()[0] for x in BASE.split(", ")), "text_hash", "lines"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in base), pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(edges, pairs)], names=names)


def rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_left, base_failed, kept).

    One for each row of `docs`. `words_left` are the words outside the lines above the limit. A document
    is kept unless base_failed, or too many symbols or repeated lines, or depleted: under `least_left` of
    its words, or under LEAST_WORDS_LEFT words, are left.

    Nulls: a null text has no words and fails the base; rows without a host form one host; ids are only
    passed on. Lines without a word are not lines. Repeated rows each give a row. An empty table gives
    no rows. Other columns of `docs` are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(host_column).cast("string"), F.lit("")).alias("host"), F.col(text_column).cast("string").alias("text"))
    measured = rows.mapInArrow(_measure, f"doc_id long, host string, {BASE}, text_hash long, {LINES}")
    measured = written(measured.withColumn("row", F.monotonically_increasing_id()), "lines")
    texts = measured.groupBy("host", "text_hash").agg(F.min("row").alias("row"))
    hosts = texts.groupBy("host").agg(F.count("*").alias("n_texts"))
    first = measured.join(texts.select("row"), "row", "left_semi")
    found = first.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    often = found.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most_documents)
    often = often.join(hosts, "host").where(F.col("n") > F.col("n_texts") * most_share).select("host", "line")
    often = within(written(often, "often"), MOST_BROADCAST)
    spread = measured.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.words")
    gone = spread.join(often, ["host", "line"], "left_semi").groupBy("row").agg(F.sum("words").alias("gone"))
    out = measured.drop("lines").join(gone, "row", "left").withColumn("words_left", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    noisy = (F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (F.col("n_dup_lines") > MOST_DUPLICATE_LINES * F.col("n_lines"))
    depleted = (F.col("words_left") < least_left * F.col("n_words")) | (F.col("words_left") < LEAST_WORDS_LEFT)
    out = out.withColumn("base_failed", failed).withColumn("kept", ~(failed | noisy | depleted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_left", "base_failed", "kept")
