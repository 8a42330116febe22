"""Reports of runs: metrics side by side, verdict changes, Markdown."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metrics of the table of several runs: label, path in a summary, format.
METRICS = (
    ("aggregate score", "aggregate_score", "percent"), ("majority score", "majority_score", "percent"), ("columns recall", "columns_recall_mean", "percent"), ("columns count match", "columns_count_match_rate", "percent"),
    ("fixtures", "fixtures_run", "number"), ("lines", "lines", "number"), ("errored lines", "errored_lines", "number"), ("known limitation lines", "known_limitation_lines", "number"),
    ("prompt tokens (mean)", "tokens.prompt_mean", "number"), ("completion tokens (mean)", "tokens.completion_mean", "number"), ("latency p50", "latency_seconds.p50", "seconds"), ("latency p95", "latency_seconds.p95", "seconds"),
    ("load max", "load_seconds.max", "seconds"), ("calls", "calls", "number"), ("fallback used", "fallback_used", "number"), ("retries", "retries", "number"), ("HTTP 429", "http_429", "number"),
)


def shown(value: Any, kind: str) -> str:
    if value is None:
        return "n/a"
    if kind == "percent":
        return f"{100 * value:.1f} %"
    if kind == "seconds":
        return f"{value:.2f} s"
    if kind == "gigabytes":
        return f"{value / 1e9:.2f} GB"
    return f"{value:,.0f}"


def _at(summary: dict[str, Any], path: str) -> Any:
    for part in path.split("."):
        summary = (summary or {}).get(part)
    return summary


def long_metrics(spark: SparkSession, summaries: dict[str, dict[str, Any]]) -> DataFrame:
    """Rows (run, place, metric, value): METRICS, then every category and field that any run has, in first-seen order."""
    keys = list(dict.fromkeys(("category", k) for s in summaries.values() for k in s.get("category_scores", {}))) + list(dict.fromkeys(("field", k) for s in summaries.values() for k in s.get("field_scores", {})))
    rows = []
    for run, s in summaries.items():
        rows += [(run, n, label, shown(_at(s, path), kind)) for n, (label, path, kind) in enumerate(METRICS)]
        rows += [(run, len(METRICS) + n, f"{kind}: {key}", shown(s.get(f"{kind}_scores", {}).get(key), "percent")) for n, (kind, key) in enumerate(keys)]
    return spark.createDataFrame(rows, "run string, place int, metric string, value string")


def table(spark: SparkSession, summaries: dict[str, dict[str, Any]]) -> DataFrame:
    """One row a metric and one column a run."""
    wide = long_metrics(spark, summaries).groupBy("place", "metric").pivot("run", list(summaries)).agg(F.first("value"))
    return wide.orderBy("place").drop("place")


def verdict_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (fixture, before, after) whose verdicts differ; a fixture that one run lacks is `not run` there."""
    joined = before.select("fixture", F.col("verdict").alias("before")).join(after.select("fixture", F.col("verdict").alias("after")), "fixture", "full_outer")
    out = joined.select("fixture", F.coalesce("before", F.lit("not run")).alias("before"), F.coalesce("after", F.lit("not run")).alias("after"))
    return out.where("before <> after").orderBy("fixture")


def label(summary: dict[str, Any], complete: bool = True) -> str:
    """A run's heading: its model, and whether it is a replay or incomplete."""
    marks = [m for m, on in (("replay", summary.get("replay_of")), ("incomplete", not complete)) if on]
    return str(summary.get("model", "run")) + (f" ({', '.join(marks)})" if marks else "")


def markdown(df: DataFrame) -> str:
    """A small table as Markdown."""
    rows = [[str(v) if v is not None else "" for v in r] for r in df.collect()]
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in lines)


def run_report(evaluations: DataFrame, summary: dict[str, Any]) -> str:
    """Sections of regular lines, errors and known limitations, then the aggregate."""
    own = evaluations.select("fixture", "repeat", "score", "error", "known_limitation", F.transform("mismatched", lambda m: m["field"]).alias("missed")).orderBy("fixture", "repeat")
    parts = [("Files", own.where("error IS NULL AND NOT known_limitation").drop("error", "known_limitation")), ("Errors", own.where("error IS NOT NULL").select("fixture", "repeat", "error")), ("Known limitations", own.where("error IS NULL AND known_limitation").drop("error", "known_limitation"))]
    return "\n\n".join(f"## {name}\n\n{markdown(df)}" for name, df in parts) + f"\n\nAggregate: {shown(summary.get('aggregate_score'), 'percent')}\n"
