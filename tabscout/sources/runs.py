"""Run files: one JSON line with the run's settings, one for each evaluation, one summary at the end."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscout.errors import RunFileError
from tabscout.functions import text

_VALUE = "struct<field:string,expected:string,actual:string>"
USAGE = "struct<model:string,prompt_tokens:long,completion_tokens:long,latency_seconds:double,attempts:int,retries:int,load_seconds:double,prompt_version:string>"
EVALUATION = (
    "fixture string, category string, repeat int, known_limitation boolean, model_used string, matched array<string>, mismatched array<struct<field:string,expected:variant,actual:variant>>, skipped array<string>, "
    f"score double, columns_recall double, columns_count_match boolean, usage {USAGE}, latency_seconds double, calls int, error string, attempt_errors map<string,string>, retries int, raw_response array<struct<model:string,text:string>>"
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); without one, and on one machine only, in its temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(top or os.path.join(tempfile.gettempdir(), 'checkpoints')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, line_no, line) of the lines that are not blank; numbers count from 1.

    Files are read by split, whatever their size. A split counts its lines, and the few counts give each split's first number.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = lines.groupBy("path", "split").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "split", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    filled = lines.where(F.col("line").rlike(rf"(?U)[^{text.SPACE[1:-1]}]"))
    return filled.join(F.broadcast(splits), ["path", "split"]).select("path", (F.col("id") + F.col("shift")).alias("line_no"), "line")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables `run`, `evaluations`, `summary` and `bad` (lines that are no JSON object) of run files."""
    rows = numbered_lines(spark, path)
    # a key stands in its line as it is unless a backslash spells it, so most lines need no parser to tell that they lack it
    own = lambda name: rows.where(F.contains("line", F.lit(f'"{name}"')) | F.contains("line", F.lit("\\"))).withColumn("json", F.try_parse_json("line"))
    kind = lambda name: F.try_variant_get("json", f"$.{name}", "variant")
    evaluations = own("fixture").where(F.try_variant_get("json", "$.fixture", "string").isNotNull())
    parsed = evaluations.select("path", "line_no", F.from_json("line", EVALUATION).alias("e")).select("path", "line_no", "e.*")
    return {
        "run": own("run").where(kind("run").isNotNull()).select("path", "line_no", kind("run").alias("run")),
        "evaluations": parsed.withColumn("retries", F.coalesce("retries", F.lit(0))),
        "summary": own("summary").where(kind("summary").isNotNull()).select("path", "line_no", kind("summary").alias("summary")),
        "bad": rows.where(F.try_parse_json("line").isNull()).select("path", "line_no", "line"),
    }


def evaluations(spark: SparkSession, path: str) -> DataFrame:
    """The evaluations of a run, parsed once: a table in the shared folder, for what goes through them many times."""
    parsed, place = read(spark, path)["evaluations"].drop("path", "line_no"), scratch(spark, "evaluations")
    parsed.write.parquet(place)
    return spark.read.schema(parsed.schema).parquet(place)


def load_summary(spark: SparkSession, path: str) -> dict[str, Any]:
    """The last summary of a run file; RunFileError names a line that is no JSON."""
    tables = read(spark, path)
    bad = tables["bad"].orderBy("line_no").first()
    if bad is not None:
        raise RunFileError(f"{path}: line {bad['line_no']} is not JSON")
    row = tables["summary"].orderBy(F.desc("line_no")).select(F.to_json("summary").alias("s")).first()
    if row is None:
        raise RunFileError(f"{path}: there is no summary")
    return json.loads(row["s"])


def settings(spark: SparkSession, path: str) -> dict[str, Any]:
    """The settings in a run's first line; RunFileError without."""
    row = read(spark, path)["run"].orderBy("path", "line_no").select(F.to_json("run").alias("r")).first()
    if row is None:
        raise RunFileError(f"{path}: there is no run line")
    return json.loads(row["r"])


def append(evaluations: DataFrame, path: str) -> None:
    """Adds evaluation lines to a run's folder, in as many files as there are tasks."""
    evaluations.select(F.to_json(F.struct(*evaluations.columns)).alias("value")).write.mode("append").text(path)


def append_line(spark: SparkSession, path: str, record: dict[str, Any]) -> None:
    """Adds one line to a run, a folder or a local file."""
    if os.path.isfile(path):
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(record, ensure_ascii=False) + "\n")
    else:
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("append").text(path)


def write(evaluations: DataFrame, path: str, run: dict[str, Any], summary: dict[str, Any] | None = None) -> None:
    """A run as JSON lines, in one part by fixture and repeat; an existing path is an error.

    A run is as many lines as files were evaluated, sorted once: small beside what it evaluates.
    """
    spark = evaluations.sparkSession
    lines = evaluations.select(F.struct(F.lit(1).alias("a"), "fixture", "repeat").alias("k"), F.to_json(F.struct(*evaluations.columns)).alias("value"))
    ends = [(0, json.dumps({"run": run}))] + ([(2, json.dumps({"summary": summary}))] if summary is not None else [])
    extra = spark.createDataFrame(ends, "a int, value string").select(F.struct("a", F.lit("").alias("fixture"), F.lit(0).alias("repeat")).alias("k"), "value")
    lines.unionByName(extra).repartitionByRange(1, "k").sortWithinPartitions("k").select("value").write.mode("errorifexists").text(path)


def output_path(template: str, model: str, stamp: str) -> str:
    """Where a run goes: {model} filled in, a .jsonl file as it is, else a file of that folder."""
    safe = re.sub(r"[^A-Za-z0-9._-]+", "-", model).strip("-")
    path = template.replace("{model}", safe)
    return path if path.endswith(".jsonl") else os.path.join(path, f"{safe}-{stamp}.jsonl")
