"""Runs: fixtures inspected and evaluated within guards, replays of recorded runs, recovery of interrupted ones.

A run goes in waves. A wave is the longest prefix of the planned files whose worst case fits into what is left of the
call budget, inspected as one query; what its calls really were is charged, and the next wave follows. That stops at
the same file as going through them one by one. Each wave is appended to the run's folder as it ends.
"""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout import constants as C
from tabscout.errors import RunFileError
from tabscout.operators import evaluation, guards, inspection, invokers
from tabscout.sources import runs

ORDER = ("fixture", "repeat")
RAW = "array<struct<model:string,text:string>>"


def planned(windows: DataFrame, manifest: DataFrame, repeats: int = 1, recorded: DataFrame | None = None) -> DataFrame:
    """Rows (fixture, repeat) to go through, by both; of a replay only those that the recorded run holds."""
    out = guards.held(manifest.select("fixture").distinct(), windows.select("fixture"))
    out = out.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return out if recorded is None else guards.held(out, recorded, list(ORDER))


def _wave(wave: DataFrame, windows: DataFrame, manifest: DataFrame, repeats: list[int], models: int, api: bool, recorded: DataFrame | None, options: dict[str, Any]) -> DataFrame:
    """Evaluation lines of the files of one wave. What the calls gave is written before it is compared, so that each is made once."""
    spark, out = windows.sparkSession, None
    for repeat in repeats:
        rows = guards.held(windows, wave.where(F.col("repeat") == repeat))
        if recorded is not None:
            told = recorded.where(F.col("repeat") == repeat).select("fixture", F.col("raw_response").cast(RAW).alias("recorded_answers"))
            rows = rows.join(told, "fixture")
        inspected = inspection.inspect_windows(rows, **options).select("fixture", "result", "usage", "error", "raw_responses")
        place = runs.scratch(spark, "inspected")
        inspected.write.parquet(place)
        lines = evaluation.evaluate(spark.read.schema(inspected.schema).parquet(place), manifest, models, api, repeat)
        out = lines if out is None else out.unionByName(lines)
    return out


def run(
    windows: DataFrame, manifest: DataFrame, path: str, invoker: invokers.Invoker = invokers.heuristic, model: str = "heuristic", fallback: str | None = None, repeats: int = 1, api: bool = False, max_calls: int | None = None,
    per_minute: int | None = None, head_bytes: int = C.DEFAULT_HEAD_BYTES, tail_bytes: int = C.DEFAULT_TAIL_BYTES, budget: float | None = None, secret: str | None = None, recorded: DataFrame | None = None, info: dict[str, Any] | None = None,
) -> dict[str, Any]:
    """Goes through the planned files, writes the run to the folder `path`, and gives its summary.

    windows: rows (fixture, size, head, tail, ...); manifest: as evaluation.evaluate() takes it. max_calls: the run stops
    before the first file whose worst case would exceed it. per_minute: calls in a minute; such a run is one task at
    a time. recorded: rows (fixture, repeat, raw_response) that answer in place of the invoker. An existing path is an error.
    """
    spark, models = windows.sparkSession, len(invokers.candidates(model, fallback))
    worst = models * (2 if api else 1)
    plan = planned(windows, manifest, repeats, recorded)
    settings = {"model": model, "fallback_model": fallback, "n_bytes": head_bytes, "tail_bytes": tail_bytes, "timeout_seconds": budget, "repeat": repeats, "started_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "fixtures_planned": plan.select("fixture").distinct().count(), **(info or {})}
    spark.createDataFrame([(json.dumps({"run": settings}),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    calls, limiter = guards.CallBudget(max_calls), guards.RateLimiter(per_minute)
    options = {"invoker": invoker, "model": model, "fallback": fallback, "budget": budget, "head_bytes": head_bytes, "tail_bytes": tail_bytes, "secret": secret}
    options |= {"recorded": "recorded_answers"} if recorded is not None else {}
    options |= {"limiter": guards.RateLimiter(per_minute), "worst": worst} if per_minute is not None else {}
    left, stopped = plan, None
    while not left.isEmpty():
        wave = left.orderBy(*ORDER)
        if max_calls is not None:
            if not calls.allows(worst):
                stopped = f"max_calls {max_calls} reached ({calls.used} made, the next file may need {worst})"
                break
            wave = wave.limit((max_calls - calls.used) // worst)
        place = runs.scratch(spark, "wave")
        wave.write.parquet(place)
        wave = spark.read.schema(plan.schema).parquet(place)
        if per_minute is not None:
            limiter.wait(min(worst, per_minute))
        place = runs.scratch(spark, "lines")
        _wave(wave, windows, manifest, list(range(1, repeats + 1)), models, api, recorded, options).write.parquet(place)
        lines = spark.read.parquet(place)
        made = lines.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("n")).first()["n"]
        runs.append(lines, path)
        calls.charge(made)
        limiter.record(made)
        left = left.join(wave, list(ORDER), "left_anti") if max_calls is not None else left.where("false")
    summary = evaluation.summarize(runs.evaluations(spark, path), {**settings, "stopped_early": stopped})
    runs.append_line(spark, path, {"summary": summary})
    return summary


def summarize_interrupted(spark: SparkSession, path: str) -> dict[str, Any]:
    """Works out and appends the summary of a run that has none, marked incomplete. RunFileError if it has one, or no run line."""
    if not runs.read(spark, path)["summary"].isEmpty():
        raise RunFileError(f"{path}: there is a summary already")
    settings = runs.settings(spark, path)
    summary = evaluation.summarize(runs.evaluations(spark, path), {**settings, "stopped_early": "interrupted", "incomplete": True})
    runs.append_line(spark, path, {"summary": summary})
    return summary


def load_replay(spark: SparkSession, path: str, head_bytes: int | None = None, tail_bytes: int | None = None) -> tuple[dict[str, Any], DataFrame]:
    """A run's settings and its answers (fixture, repeat, raw_response). RunFileError without a run line or answers, ValueError for other windows."""
    settings = runs.settings(spark, path)
    guards.same_windows(settings, settings.get("n_bytes") if head_bytes is None else head_bytes, settings.get("tail_bytes") if tail_bytes is None else tail_bytes)
    answers = runs.read(spark, path)["evaluations"].where(F.col("raw_response").isNotNull()).select(*ORDER, "raw_response")
    if answers.isEmpty():
        raise RunFileError(f"{path}: there are no recorded answers")
    return settings, answers


def replay(windows: DataFrame, manifest: DataFrame, source: str, path: str, model: str | None = None, fallback: str | None = None, head_bytes: int | None = None, tail_bytes: int | None = None, **live: Any) -> dict[str, Any]:
    """Runs the files anew on the answers of a recorded run; no model is called. The summary has replay_of and replay_skipped.

    live: options of live runs (backend, per_minute, max_calls, dry_run), which are refused. Fixtures that the
    recorded run lacks are skipped and counted; if it has none of them, that is a ValueError.
    """
    given = sorted(k for k, v in live.items() if v is not None and v is not False)
    if given:
        raise ValueError(f"a replay calls no model: leave out {', '.join(given)}")
    spark = windows.sparkSession
    settings, answers = load_replay(spark, source, head_bytes, tail_bytes)
    wanted = guards.held(manifest.select("fixture").distinct(), windows.select("fixture"))
    own = guards.held(wanted, answers)
    n, held = wanted.count(), own.count()
    if not held:
        raise ValueError(f"{source} holds none of the fixtures")
    info = {"replay_of": source, "replay_skipped": n - held} | {k: settings[k] for k in ("backend", "prompt_version") if k in settings}
    return run(
        windows, manifest, path, model=model or settings["model"], fallback=fallback or settings.get("fallback_model"), repeats=settings.get("repeat") or 1, head_bytes=settings["n_bytes"], tail_bytes=settings["tail_bytes"], budget=settings.get("timeout_seconds"),
        recorded=answers, info=info,
    )


EXPECTED = "struct<encoding:string,delimiter:string,quotechar:string,escapechar:string,doublequote:boolean,has_header:boolean,header_row_index:int,footer_lines:array<string>,footer_rows_to_skip:int,columns:array<string>>"


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (fixture, category, known_limitation, expected, present, expected_error, subsets) of a JSON list of files."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)
    rows = [
        (e["filename"], e.get("category"), bool(e.get("known_limitation")), json.dumps(e.get("expected", {})), sorted(e.get("expected", {})), e.get("expected_error") or e.get("expected", {}).get("expected_error"), e.get("subsets", []))
        for e in entries
    ]
    df = spark.createDataFrame(rows, "fixture string, category string, known_limitation boolean, expected string, present array<string>, expected_error string, subsets array<string>")
    return df.withColumn("expected", F.from_json("expected", EXPECTED))


def fixture_windows(spark: SparkSession, folder: str, manifest: DataFrame, head_bytes: int = C.DEFAULT_HEAD_BYTES, tail_bytes: int = C.DEFAULT_TAIL_BYTES) -> DataFrame:
    """Windows of the manifest's files in a folder, by name."""
    from tabscout.sources import windows

    rows = windows.read(spark, os.path.join(folder, "*"), head_bytes, tail_bytes)
    named = rows.withColumn("fixture", F.substring_index(F.regexp_replace("path", r"\\", "/"), "/", -1))
    return guards.held(named, manifest.select("fixture"))
