"""Splitting lines into fields as Python's csv module does: Arrow UDFs and a table function.

A line is split alone, quotes open a field only at its start, spaces are kept and nothing is strict.
No built-in function of Spark does this: from_csv needs a fixed schema and drops surplus fields.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def split_fields(line: str | None, delimiter: str | None, quote: str | None) -> list[str] | None:
    """The fields of one line; [] of an empty one; None if it, or the dialect, can't be read."""
    if line is None or not delimiter:
        return None
    if line and quote and quote not in line and "\r" not in line and "\n" not in line and len(delimiter) == 1:
        return line.split(delimiter)
    try:
        return next(csv.reader([line], delimiter=delimiter, quotechar=quote or '"'), None)
    except (csv.Error, TypeError, ValueError):
        return None


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def split_rows(lines: pa.Array, delimiter: pa.Array, quote: pa.Array) -> pa.Array:
    """For each array of lines: the fields of each."""
    rows = [None if x is None else [split_fields(line, d, q) for line in x] for x, d, q in zip(lines.to_pylist(), delimiter.to_pylist(), quote.to_pylist())]
    return pa.array(rows, pa.list_(pa.list_(pa.string())))


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def field_counts(lines: pa.Array, delimiters: pa.Array, quote: pa.Array) -> pa.Array:
    """For each array of lines and each delimiter: the number of fields of each line (null: unparsable)."""
    rows = []
    for x, ds, q in zip(lines.to_pylist(), delimiters.to_pylist(), quote.to_pylist()):
        rows.append([[None if (f := split_fields(line, d, q)) is None else len(f) for line in x or []] for d in ds or []])
    return pa.array(rows, pa.list_(pa.list_(pa.int32())))


_LINES = ArrayType(ArrayType(StringType()))
SPLITS = ArrayType(StructType([StructField("counts", ArrayType(IntegerType())), StructField("rows", _LINES), StructField("fields", _LINES), StructField("bare", _LINES)]))
_ARROW_LINES = pa.list_(pa.list_(pa.string()))
_ARROW_SPLITS = pa.list_(pa.struct([("counts", pa.list_(pa.int32())), ("rows", _ARROW_LINES), ("fields", _ARROW_LINES), ("bare", _ARROW_LINES)]))


@F.arrow_udf(SPLITS)
def splits(head: pa.Array, end: pa.Array, bare: pa.Array, keys: pa.Array, bare_keys: pa.Array, delimiters: pa.Array, asked: pa.Array, quote: pa.Array) -> pa.Array:
    """For each delimiter tried: field counts of the head's lines by the quote asked for, and the fields of the head's, of the end's and of the stripped end's lines.

    The end's lines are followed by the keys, which go by delimiter. All splitting that grounding needs is here, so
    that rows go to Python once.
    """
    out = []
    for h, e, b, ks, bks, ds, q1, q2 in zip(*(x.to_pylist() for x in (head, end, bare, keys, bare_keys, delimiters, asked, quote))):
        own = []
        for k, d in enumerate(ds or []):
            rows = [split_fields(x, d, q2) for x in h or []]
            counted = rows if q1 == q2 else [split_fields(x, d, q1) for x in h or []]
            more, bare_more = (x[k] if x and x[k] else [] for x in (ks, bks))
            own.append({"counts": [None if f is None else len(f) for f in counted], "rows": rows, "fields": [split_fields(x, d, q2) for x in [*(e or []), *more]], "bare": [split_fields(x, d, q2) for x in [*(b or []), *bare_more]]})
        out.append(own)
    return pa.array(out, _ARROW_SPLITS)


class DelimitedLines:
    """Table function delimited_lines(text, delimiter, quote): rows (line_no, line, fields)."""

    def eval(self, text: str, delimiter: str, quote: str) -> Iterator[tuple[int, str, list[str] | None]]:
        if text is not None:
            for n, line in enumerate(python_lines(text)):
                yield n, line, split_fields(line, delimiter, quote)


def python_lines(text: str) -> list[str]:
    """Lines that end with CRLF, CR or LF only; a final break begins no line."""
    out = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return out[:-1] if out[-1] == "" else out


def register(spark: SparkSession) -> None:
    """Makes split_rows(), field_counts() and delimited_lines() known to SQL."""
    spark.udf.register("split_rows", split_rows)
    spark.udf.register("field_counts", field_counts)
    spark.udtf.register("delimited_lines", F.udtf(DelimitedLines, returnType="line_no int, line string, fields array<string>"))


#: Not to be inlined where the optimiser would run them again, or inside a lambda, where they cannot run.
split_rows = split_rows.asNondeterministic()
field_counts = field_counts.asNondeterministic()
splits = splits.asNondeterministic()
