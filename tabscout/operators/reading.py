"""Reading a file by its inspection result: the scan with an inferred dialect."""

from __future__ import annotations

import codecs as python_codecs
import csv
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions import codecs
from tabscout.functions.fields import python_lines

# --- fixed values: Java's names of codecs that Spark reads ---
JAVA_CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "cp1252": "windows-1252", "iso8859-1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}


def reader_options(result: dict[str, Any]) -> dict[str, str]:
    """Options of Spark's CSV reader for a result. Without any escape, U+0000 stands in for Spark's backslash."""
    escape = result["escapechar"] or (result["quotechar"] if result["doublequote"] else "\0")
    charset = JAVA_CHARSETS.get(codecs.canonical_name(result["encoding"]) or "", "UTF-8")
    return {"sep": result["delimiter"], "quote": result["quotechar"], "escape": escape, "header": "false", "multiLine": "true", "encoding": charset, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def skipped(result: dict[str, Any]) -> tuple[int, int]:
    """Physical lines before the data, and after it."""
    return (result["header_row_index"] + 1 if result["has_header"] else 0), result["footer_rows_to_skip"]


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    """The result's names, which the reader would rename; fewer columns are filled with nulls, surplus ones dropped."""
    have = [F.col(f"`{c}`") for c in df.columns]
    have += [F.lit(None).cast("string")] * (len(columns) - len(have))
    return df.select(*(c.alias(f"__{k}") for k, c in enumerate(have[: len(columns)]))).toDF(*columns)


def read_rows(data: bytes, result: dict[str, Any]) -> Iterator[list[str]]:
    """Rows of a file's bytes by the csv module: lines before and after the data skipped, blank rows dropped."""
    name = codecs.canonical_name(result["encoding"]) or "utf-8"
    text = data.decode(name, errors="replace").removeprefix("﻿")
    before, after = skipped(result)
    lines = python_lines(text)
    kept = lines[before : len(lines) - after if after else None]
    for row in csv.reader((x + "\n" for x in kept), delimiter=result["delimiter"], quotechar=result["quotechar"], escapechar=result["escapechar"], doublequote=result["doublequote"]):
        if row:
            yield row


def read_delimited(spark: SparkSession, path: str, result: dict[str, Any]) -> DataFrame:
    """A file as a DataFrame of strings, with the result's column names.

    Nothing to skip, in a charset that Spark reads: its CSV reader. Lines to skip in UTF-8: numbered lines,
    filtered, then parsed by from_csv(); the file is split over tasks and its order kept without a sort. Else the
    file's bytes are decoded by Python on an executor.
    """
    before, after = skipped(result)
    name = codecs.canonical_name(result["encoding"]) or "utf-8"
    columns = list(result["columns"])
    if name in JAVA_CHARSETS and after == 0 and before == 0:
        return _named(spark.read.options(**reader_options(result)).csv(path), columns)
    if name in ("utf-8", "ascii", "utf-8-sig"):
        line = F.regexp_replace("line", "\\A\ufeff+", "")
        kept = numbered_lines(spark, path).where((F.col("n") >= before) & (F.col("n") < F.col("total") - after)).select(F.when(F.col("n") == 0, line).otherwise(F.col("line")).alias("line"))
        options = {k: v for k, v in reader_options(result).items() if k not in ("multiLine", "encoding", "header")}
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(columns))])
        return kept.where(F.col("line").rlike(r"[^\x00-\x20]")).select(F.from_csv("line", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r")).select("r.*").toDF(*columns)
    width = len(columns)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                rows = [(r + [None] * width)[:width] for r in read_rows(bytes(content), result)]
                yield pd.DataFrame(rows, columns=[f"c{k}" for k in range(width)], dtype=object)

    whole = spark.read.format("binaryFile").load(path).select("content")
    return whole.mapInPandas(run, ", ".join(f"c{k} string" for k in range(width))).toDF(*columns)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line, n, total) of a text file in its order: each line's number from 0, and how many there are.

    A split counts its lines, and the few counts give each split's first number. Both reads of the file are split alike.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("split").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    by = Window.orderBy("split")  # a row for each split of the file
    splits = splits.select("split", "first", F.coalesce(F.sum("lines").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("lines").over(Window.partitionBy()).alias("total"))
    return lines.join(F.broadcast(splits), "split").select("line", (F.col("before") + F.col("id") - F.col("first")).alias("n"), "total")


def known(encoding: str) -> bool:
    try:
        return python_codecs.lookup(encoding) is not None
    except LookupError:
        return False
