"""inspect(): sources to one result row a file. Sampling and grounding are projections; only the call is a node."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout import constants as C
from tabscout import errors
from tabscout.operators import grounding, invokers, prompts, sampling
from tabscout.sources import windows


def _failure(kind: str, message) -> Any:
    return F.struct(F.lit(kind).alias("class"), message.alias("message"), F.expr("CAST(map() AS map<string,string>)").alias("attempts"))


def inspect_windows(df: DataFrame, invoker: invokers.Invoker = invokers.heuristic, model: str = "heuristic", fallback: str | None = None, budget: float | None = None, head_bytes: int = C.DEFAULT_HEAD_BYTES, tail_bytes: int = C.DEFAULT_TAIL_BYTES, secret: str | None = None, **calls: Any) -> DataFrame:
    """`df` (size, head, tail, others) with result, usage, error, diagnostics and answer; one row a file.

    Files that could not be read (`read_error`) or are empty get their error and no call. calls: options of invokers.invoke(); a
    `recorded` column is not passed on. Columns of `df` that have the name of one of the results are an error.
    """
    clash = {"encoding", "head_text", "tail_text", "covers_whole_file", "lines_omitted", "prompt", "raw", "answer", "result", "usage", "error", "raw_responses", "diagnostics"} & set(df.columns)
    if clash:
        raise ValueError(f"columns in the way of the results: {', '.join(sorted(clash))}")
    if budget is not None and budget <= 0:
        raise ValueError("the time budget must be above 0")
    own = [c for c in df.columns if c not in ("head", "tail", calls.get("recorded"))]
    rows = sampling.sample(df, head_bytes, tail_bytes)
    unread = F.col("read_error") if "read_error" in df.columns else F.lit(None).cast("string")
    early = F.when(unread.isNotNull(), _failure("FileSampleReadError", unread)).when(F.coalesce(F.octet_length("head"), F.lit(0)) == 0, _failure("EmptySampleError", F.lit("the source is empty")))
    rows = rows.withColumn("__early", early)
    text = prompts.prompt(F.col("head_text"), F.col("tail_text"), F.col("covers_whole_file"), F.col("encoding"))
    rows = rows.withColumn("prompt", F.when(F.col("__early").isNull(), text)).drop("head", "tail")
    rows = invokers.invoke(rows, invoker, model, fallback, budget, secret, **calls)
    rows = grounding.ground(rows).withColumn("error", F.coalesce("__early", "error"))
    return rows.select(*own, "encoding", "head_text", "tail_text", "covers_whole_file", "lines_omitted", "prompt", "answer", "result", "usage", "error", "raw_responses", "diagnostics")


def inspect(spark: SparkSession, source: str | bytes | bytearray | memoryview | os.PathLike | DataFrame, column: str = "content", head_bytes: int = C.DEFAULT_HEAD_BYTES, tail_bytes: int = C.DEFAULT_TAIL_BYTES, **options: Any) -> DataFrame:
    """One row for each file of a path or glob, each row of a DataFrame with a binary column, or one buffer."""
    if isinstance(source, DataFrame):
        rows = sampling.windows_of(source, column, head_bytes, tail_bytes).drop(column)
    elif isinstance(source, (bytes, bytearray, memoryview)):
        one = spark.createDataFrame([(bytes(source),)], "content binary")
        rows = sampling.windows_of(one, "content", head_bytes, tail_bytes).drop("content").withColumn("path", F.concat(F.lit("<"), F.col("size").cast("string"), F.lit(" bytes in memory>")))
    elif isinstance(source, (str, os.PathLike)):
        rows = windows.read(spark, os.fspath(source), head_bytes, tail_bytes)
    else:
        raise TypeError(f"a path, bytes or a DataFrame is expected, not {type(source).__name__}")
    return inspect_windows(rows, head_bytes=head_bytes, tail_bytes=tail_bytes, **options)


def inspect_one(spark: SparkSession, source: Any, **options: Any) -> dict[str, Any]:
    """The result of one source as a dict; raises its error. A binary stream is read from where it stands."""
    if hasattr(source, "read") and not isinstance(source, (str, bytes)):
        head, tail, size = windows.stream_windows(source, options.get("head_bytes", C.DEFAULT_HEAD_BYTES), options.get("tail_bytes", C.DEFAULT_TAIL_BYTES))
        rows = inspect_windows(spark.createDataFrame([(size, head, tail)], "size long, head binary, tail binary"), **options)
    else:
        rows = inspect(spark, source, **options)
    row = rows.select("result", "usage", "error").first()
    if row is None:
        raise errors.FileSampleReadError(f"no file at {source!r}")
    if row["error"] is not None:
        kind = getattr(errors, row["error"]["class"], errors.TabscoutError)
        args = (row["error"]["attempts"],) if issubclass(kind, errors.InspectionFailedError) else ()
        raise kind(row["error"]["message"], *args)
    return {**row["result"].asDict(recursive=True), "usage": row["usage"].asDict() if row["usage"] else None}
