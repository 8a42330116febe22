"""Bounded samples: byte windows to decoded head and tail texts of a few lines. One projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout import constants as C
from tabscout.functions import codecs, text


def check_budget(name: str, value: int, least: int) -> int:
    """A window's size in bytes, if it is in range."""
    if not least <= value <= C.MAX_WINDOW_BYTES:
        raise ValueError(f"{name} must be between {least} and {C.MAX_WINDOW_BYTES}, not {value}")
    return value


def windows_of(df: DataFrame, column: str = "content", head_bytes: int = C.DEFAULT_HEAD_BYTES, tail_bytes: int = C.DEFAULT_TAIL_BYTES) -> DataFrame:
    """`df` with size, head and tail of a binary column, as the windows source gives them for files.

    The tail is the last bytes past the head, before code units are known: sample() aligns it.
    """
    check_budget("head_bytes", head_bytes, 1)
    check_budget("tail_bytes", tail_bytes, 0)
    content, size = F.col(column), F.octet_length(column).cast("long")
    tail = F.least(F.lit(tail_bytes), F.greatest(size - head_bytes, F.lit(0))).cast("int")
    out = df.withColumn("size", size).withColumn("head", F.substring(content, 1, head_bytes))
    return out.withColumn("tail", F.when(tail > 0, F.substring(content, (size - tail + 1).cast("int"), tail)).otherwise(F.lit(b"")))


def bounded(head: Column, tail: Column, covers: Column) -> Column:
    """struct<head_text,tail_text,lines_omitted>: at most MAX_HEAD_LINES and MAX_TAIL_LINES lines.

    A whole text of more lines than both gets a tail of its own last lines.
    """
    h, t = text.lines(head, keep_ends=True), text.lines(tail, keep_ends=True)
    both = C.MAX_HEAD_LINES + C.MAX_TAIL_LINES
    whole = tail.isNull() & covers
    first = text.joined(F.slice(h, 1, C.MAX_HEAD_LINES))
    alone = F.struct(head.alias("head_text"), F.lit(None).cast("string").alias("tail_text"), F.lit(0).alias("lines_omitted"))
    split = F.struct(first.alias("head_text"), text.joined(text.last(h, C.MAX_TAIL_LINES)).alias("tail_text"), (F.size(h) - both).alias("lines_omitted"))
    over = F.greatest(F.size(h) - C.MAX_HEAD_LINES, F.lit(0)) + F.when(tail.isNotNull(), F.greatest(F.size(t) - C.MAX_TAIL_LINES, F.lit(0))).otherwise(0)
    pair = F.struct(first.alias("head_text"), F.when(tail.isNotNull(), text.joined(text.last(t, C.MAX_TAIL_LINES))).alias("tail_text"), over.alias("lines_omitted"))
    return F.when(whole & (F.size(h) <= both), alone).when(whole, split).otherwise(pair)


def sample(windows: DataFrame, head_bytes: int = C.DEFAULT_HEAD_BYTES, tail_bytes: int = C.DEFAULT_TAIL_BYTES) -> DataFrame:
    """`windows` (size, head, tail) with encoding, head_text, tail_text, covers_whole_file, lines_omitted.

    tail null: the end was not reached (a stream past its scan limit). size null: not known, so a full
    head without a tail is taken as cut. An empty source has an empty head_text; inspect() reports it.
    """
    check_budget("head_bytes", head_bytes, 1)
    check_budget("tail_bytes", tail_bytes, 0)
    full = F.octet_length("head") >= head_bytes
    rows = windows.withColumn("__read", codecs.read(F.col("head"), F.col("tail"), full))
    length = F.octet_length("tail")
    reached = F.col("tail").isNotNull() & ((F.coalesce(length, F.lit(0)) > 0) | (F.lit(tail_bytes != 0) & (F.col("size").isNull() | (F.col("size") <= F.octet_length("head")))) | F.coalesce(F.col("size") == F.octet_length("head"), F.lit(False)))
    rows = rows.withColumn("covers_whole_file", F.when(full, F.coalesce(reached, F.lit(False))).otherwise(F.lit(True)))
    rows = rows.withColumns({"encoding": F.col("__read.encoding"), "__head_text": F.col("__read.head_text"), "__tail_text": F.col("__read.tail_text")})
    cut = full & (F.col("__tail_text").isNotNull() | ~F.col("covers_whole_file"))
    rows = rows.withColumn("__head_text", F.when(cut, text.trim_to_break(F.col("__head_text"))).otherwise(F.col("__head_text")))
    rows = rows.withColumn("__b", bounded(F.col("__head_text"), F.col("__tail_text"), F.col("covers_whole_file")))
    return rows.select(*windows.columns, "encoding", "covers_whole_file", F.col("__b.head_text").alias("head_text"), F.col("__b.tail_text").alias("tail_text"), F.col("__b.lines_omitted").alias("lines_omitted"))
