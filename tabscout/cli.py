"""python -m tabscout COMMAND: inspect files, evaluate a run, replay or recover one, compare several.

Results are JSON lines or Markdown on standard output; exit 1 if any file could not be inspected or a run is refused.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tabscout import constants as C
from tabscout import settings
from tabscout.errors import TabscoutError
from tabscout.operators import evaluation, guards, inspection, invokers, live, prompts, reports, runner, sampling
from tabscout.sources import runs


def bounded(least: int, most: int) -> Callable[[str], int]:
    def convert(value: str) -> int:
        n = int(value)
        if not least <= n <= most:
            raise argparse.ArgumentTypeError(f"must be between {least} and {most}")
        return n

    return convert


def budget(value: str) -> float | None:
    """Seconds; 0 is no limit."""
    seconds = float(value)
    if not 0 <= seconds < float("inf"):
        raise argparse.ArgumentTypeError("must be 0 or more")
    return seconds or None


def _common(one: argparse.ArgumentParser, fixtures: bool) -> None:
    window = None if fixtures else C.DEFAULT_HEAD_BYTES, None if fixtures else C.DEFAULT_TAIL_BYTES
    one.add_argument("--backend", choices=settings.BACKENDS)
    one.add_argument("--model")
    one.add_argument("--fallback-model")
    one.add_argument("--bytes", type=bounded(1, C.MAX_WINDOW_BYTES), default=window[0])
    one.add_argument("--tail-bytes", type=bounded(0, C.MAX_WINDOW_BYTES), default=window[1])
    one.add_argument("--timeout", type=budget, default=C.HOST_MAX_TIMEOUT_SECONDS)
    one.add_argument("--env-file", default=".env")
    one.add_argument("--no-env-file", action="store_true")
    if fixtures:
        one.add_argument("manifest", help="a JSON list of files and what they should give")
        one.add_argument("folder", help="where the files are")
        one.add_argument("--out", default="runs", help="a folder, or a path with {model}")
        one.add_argument("--category", action="append")
        one.add_argument("--name", action="append")
        one.add_argument("--subset")
        one.add_argument("--first", type=bounded(1, 1 << 31))
        one.add_argument("--max-calls", type=bounded(0, 1 << 31))
        one.add_argument("--rpm", type=bounded(1, 1 << 31))
        one.add_argument("--dry-run", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tabscout")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("inspect")
    one.add_argument("path")
    one.add_argument("--stats", action="store_true")
    _common(one, False)
    one = commands.add_parser("run")
    one.add_argument("--repeat", type=bounded(1, 1000), default=1)
    _common(one, True)
    one = commands.add_parser("replay")
    one.add_argument("source", help="the run that was recorded")
    _common(one, True)
    one = commands.add_parser("summarize")
    one.add_argument("run", help="an interrupted run")
    one = commands.add_parser("compare")
    one.add_argument("runs", nargs="+")
    for own in commands.choices.values():
        own.add_argument("--log-level", default="ERROR")
    return top


def _backend(args: argparse.Namespace) -> tuple[settings.Settings, Any]:
    own = settings.load(env_file=None if args.no_env_file else args.env_file)
    own = dataclasses.replace(own, llm_backend=args.backend or own.llm_backend).ready()
    made = {"offline": lambda: invokers.heuristic, "local": lambda: live.LocalChat(own.local_host, seconds=args.timeout), "api": lambda: live.CloudGenerate(own.api_key, seconds=args.timeout)}
    return own, made[own.llm_backend]()


def inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    own, invoker = _backend(args)
    model, fallback = own.models()
    rows = inspection.inspect(spark, args.path, args.bytes, args.tail_bytes, invoker=invoker, model=args.model or model, fallback=args.fallback_model or fallback, budget=args.timeout, secret=own.api_key)
    failed = False
    for r in rows.select("path", F.to_json("result", {"ignoreNullFields": "false"}).alias("result"), F.to_json("usage").alias("usage"), "error").toLocalIterator():
        failed = failed or r["error"] is not None
        print(json.dumps({"path": r["path"], "result": r["result"] and json.loads(r["result"]), "error": r["error"] and f"{r['error']['class']}: {r['error']['message']}"}, ensure_ascii=False))
        if args.stats and r["usage"]:
            print(r["usage"], file=sys.stderr)
    return int(failed)


def _report(spark: SparkSession, path: str, summary: dict[str, Any]) -> int:
    print(reports.run_report(runs.read(spark, path)["evaluations"], summary))
    print(json.dumps({"out": path, "summary": summary}, ensure_ascii=False))
    return 0


def _selected(spark: SparkSession, args: argparse.Namespace):
    return guards.select_fixtures(runner.load_manifest(spark, args.manifest), args.category, args.name, args.first, args.subset)


def _out(args: argparse.Namespace, model: str) -> str:
    return runs.output_path(args.out, model, time.strftime("%Y%m%dT%H%M%SZ", time.gmtime()))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    manifest = _selected(spark, args)
    head, tail = C.DEFAULT_HEAD_BYTES if args.bytes is None else args.bytes, C.DEFAULT_TAIL_BYTES if args.tail_bytes is None else args.tail_bytes
    windows = runner.fixture_windows(spark, args.folder, manifest, head, tail)
    if args.dry_run:
        rows = sampling.sample(windows, head, tail)
        told = prompts.prompt(F.col("head_text"), F.col("tail_text"), F.col("covers_whole_file"), F.col("encoding"))
        total = rows.select(F.length(told).alias("n")).agg(F.count("*").alias("files"), F.sum("n").alias("chars"), F.sum(prompts.estimated_tokens(F.col("n"))).alias("tokens")).first()
        print(json.dumps(total.asDict()))
        return 0
    own, invoker = _backend(args)
    model, fallback = own.models()
    model, fallback = args.model or model, args.fallback_model or fallback
    path = _out(args, model)
    summary = runner.run(
        windows, manifest, path, invoker=invoker, model=model, fallback=fallback, repeats=args.repeat, api=own.llm_backend == "api", max_calls=args.max_calls, per_minute=args.rpm, head_bytes=head, tail_bytes=tail, budget=args.timeout, secret=own.api_key,
        info={"backend": own.llm_backend, "prompt_version": prompts.PROMPT_VERSION},
    )
    return _report(spark, path, summary)


def replay(spark: SparkSession, args: argparse.Namespace) -> int:
    info, _ = runner.load_replay(spark, args.source, args.bytes, args.tail_bytes)
    manifest = _selected(spark, args)
    windows = runner.fixture_windows(spark, args.folder, manifest, info["n_bytes"], info["tail_bytes"])
    path = _out(args, args.model or info["model"])
    summary = runner.replay(windows, manifest, args.source, path, args.model, args.fallback_model, args.bytes, args.tail_bytes, backend=args.backend, per_minute=args.rpm, max_calls=args.max_calls, dry_run=args.dry_run)
    return _report(spark, path, summary)


def summarize(spark: SparkSession, args: argparse.Namespace) -> int:
    return _report(spark, args.run, runner.summarize_interrupted(spark, args.run))


def compare(spark: SparkSession, args: argparse.Namespace) -> int:
    """The runs side by side, and the verdicts in which the last differs from the first."""
    summaries = [runs.load_summary(spark, p) for p in args.runs]
    names = [f"{n}: {reports.label(s, not s.get('incomplete'))}" for n, s in enumerate(summaries, 1)]
    print(reports.markdown(reports.table(spark, dict(zip(names, summaries)))))
    if len(args.runs) > 1:
        told = []
        for p in (args.runs[0], args.runs[-1]):
            lines = runs.read(spark, p)["evaluations"]
            told.append(evaluation.verdicts(lines, evaluation.field_stats(evaluation.votes(lines))))
        print("\n" + reports.markdown(reports.verdict_changes(*told)))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = SparkSession.builder.appName("tabscout").getOrCreate()
        spark.sparkContext.setLogLevel(args.log_level)
        return {"inspect": inspect, "run": run, "replay": replay, "summarize": summarize, "compare": compare}[args.command](spark, args)
    except (TabscoutError, ValueError) as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1
