"""Evaluation: results against ground truth, votes of repeats, summaries. DataFrame queries throughout.

`evaluations` has the columns of a run file's evaluation lines (see sources.runs). Comparisons are rows
(fixture, field, ...), so every score is one group-by; the driver gets scores, and of a report the verdict of
each fixture.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout import constants as C
from tabscout.functions import codecs, text

#: Place of each field in reports.
ORDER = {f: k for k, f in enumerate(C.COMPARABLE_FIELDS)}


def field_order(field: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair)), field), F.lit(len(ORDER)))


def comparisons(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows (fixture, field, expected, actual, verdict) of results (fixture, result) and truth (fixture, expected, present).

    expected is a struct of nullable fields, `present` the names that the truth has at all. A field that is
    missing or null is `skipped`, but a present null escapechar is scored. Encodings match by name, footer
    lines stripped; values are given as JSON.
    """
    rows = results.join(manifest, "fixture")
    e, r = F.col("expected"), F.col("result")

    def one(f: str) -> Column:
        scored = F.array_contains("present", f) & (e[f].isNotNull() | F.lit(f in C.NULL_SCORED_FIELDS))
        if f == "encoding":
            match = codecs.matches_label(e[f], r[f])
        elif f == "footer_lines":
            match = F.transform(e[f], text.strip) == F.transform(r[f], text.strip)
        else:
            match = e[f].eqNullSafe(r[f])
        verdict = F.when(~scored, "skipped").when(F.coalesce(match, F.lit(False)), "matched").otherwise("mismatched")
        as_json = lambda v: F.get_json_object(F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}), "$.v")
        return F.struct(F.lit(f).alias("field"), as_json(e[f]).alias("expected"), as_json(r[f]).alias("actual"), verdict.alias("verdict"))

    spread = rows.select("fixture", F.explode(F.array(*(one(f) for f in C.RESULT_FIELDS))).alias("c"))
    return spread.select("fixture", "c.*")


def evaluate(inspected: DataFrame, manifest: DataFrame, models: int = 1, api: bool = False, repeat: int = 1) -> DataFrame:
    """Evaluation lines, as a run file has them, of inspected files (fixture, result, usage, error, raw_responses).

    `manifest` has fixture, category, known_limitation, expected, present and expected_error. A file that
    raises just the expected error matches on the field expected_error and costs no call; one that should have
    and did not misses it. Any other error is the line's. A failed file counts as its worst case of calls.
    """
    rows = inspected.join(manifest.select("fixture", "category", "known_limitation", "expected_error"), "fixture")
    told = comparisons(inspected.where(F.col("result").isNotNull()).select("fixture", "result"), manifest)
    of = lambda verdict, what: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("verdict") == verdict, F.struct(field_order(F.col("field")).alias("o"), what.alias("x"))))))
    missed = F.struct("field", "expected", "actual")
    per = told.groupBy("fixture").agg(of("matched", F.col("field")).alias("m"), of("mismatched", missed).alias("w"), of("skipped", F.col("field")).alias("s"))
    names = manifest.join(inspected.where(F.col("result").isNotNull()).select("fixture", "result"), "fixture").select("fixture", F.col("expected.columns").alias("expected"), F.col("result.columns").alias("actual"))
    rows = rows.join(per, "fixture", "left").join(column_recall(names), "fixture", "left")
    strings, wrongs = "array<string>", "array<struct<field:string,expected:string,actual:string>>"
    x = lambda c: F.transform(c, lambda v: v["x"])
    expected = F.coalesce(F.col("error.class") == F.col("expected_error"), F.lit(False))
    failed = F.col("error").isNotNull() & ~expected
    escaped = F.col("result").isNotNull() & F.col("expected_error").isNotNull()
    never = F.array(F.struct(F.lit("expected_error").alias("field"), F.to_json(F.array("expected_error")).alias("expected"), F.lit(None).cast("string").alias("actual")))
    matched = F.when(expected, F.array(F.lit("expected_error"))).otherwise(F.coalesce(x("m"), F.expr(f"CAST(array() AS {strings})")))
    wrong = F.coalesce(x("w"), F.expr(f"CAST(array() AS {wrongs})")).cast(wrongs)
    worst = models * (2 if api else 1)
    out = rows.withColumn("matched", matched).withColumn("mismatched", F.when(escaped, F.concat(wrong, never.cast(wrongs))).otherwise(wrong))
    out = out.withColumn("skipped", F.when(expected, F.array(*(F.lit(f) for f in C.RESULT_FIELDS))).otherwise(F.coalesce(x("s"), F.expr(f"CAST(array() AS {strings})"))))
    message = F.when(failed, F.concat_ws(": ", F.col("error.class"), F.col("error.message")))
    calls = F.when(expected, 0).when(failed, worst).otherwise(F.col("usage.attempts") + F.col("usage.retries"))
    return out.select(
        "fixture", "category", F.lit(repeat).alias("repeat"), "known_limitation", F.col("usage.model").alias("model_used"), "matched", "mismatched", "skipped", line_score(F.col("matched"), F.col("mismatched"), message).alias("score"),
        "columns_recall", "columns_count_match", "usage", F.col("usage.latency_seconds").alias("latency_seconds"), calls.cast("int").alias("calls"), message.alias("error"), F.coalesce("error.attempts", F.expr("CAST(map() AS map<string,string>)")).alias("attempt_errors"),
        F.coalesce("usage.retries", F.lit(0)).alias("retries"), F.col("raw_responses").alias("raw_response"),
    )


def column_recall(names: DataFrame) -> DataFrame:
    """Rows (fixture, columns_recall, columns_count_match) of rows (fixture, expected, actual), arrays of names.

    Recall is the size of the multiset intersection of stripped names, by the number expected; null if none is.
    """
    def numbered(column: str, other: str) -> DataFrame:
        one = names.where(F.col("expected").isNotNull()).select("fixture", F.explode(column).alias("name")).select("fixture", text.strip(F.col("name")).alias("name"))
        return one.groupBy("fixture", "name").agg(F.count("*").alias(other))

    shared = numbered("expected", "wanted").join(numbered("actual", "got"), ["fixture", "name"]).groupBy("fixture").agg(F.sum(F.least("wanted", "got")).alias("shared"))
    sized = names.select("fixture", F.size("expected").alias("n"), (F.size("expected") == F.size("actual")).alias("same"), F.col("expected").isNull().alias("unknown"))
    out = sized.join(shared, "fixture", "left")
    recall = F.when(~F.col("unknown") & (F.col("n") > 0), F.coalesce("shared", F.lit(0)) / F.col("n"))
    return out.select("fixture", recall.alias("columns_recall"), F.when(~F.col("unknown"), F.col("same")).alias("columns_count_match"))


def line_score(matched: Column, mismatched: Column, error: Column) -> Column:
    """Matched by compared; null on an error or without anything compared."""
    n = F.size(matched) + F.size(mismatched)
    return F.when(error.isNull() & (n > 0), F.size(matched) / n)


def votes(evaluations: DataFrame) -> DataFrame:
    """Rows (fixture, repeat, field, answer): what each repeat says of each field that any repeat compared.

    A match is one answer, a mismatch its actual value in JSON, a failed repeat the error answer; a repeat
    that did not compare the field has none.
    """
    hit = evaluations.where(F.col("error").isNull()).select("fixture", "repeat", F.explode("matched").alias("field"), F.lit(C.MATCH_ANSWER).alias("answer"))
    miss = evaluations.where(F.col("error").isNull()).select("fixture", "repeat", F.explode("mismatched").alias("m")).select("fixture", "repeat", F.col("m.field").alias("field"), F.coalesce(F.col("m.actual").cast("string"), F.lit("null")).alias("answer"))
    any_hit = evaluations.select("fixture", F.explode(F.concat("matched", F.transform("mismatched", lambda m: m["field"]))).alias("field")).distinct()
    failed = evaluations.where(F.col("error").isNotNull()).select("fixture", "repeat").join(any_hit, "fixture").select("fixture", "repeat", "field", F.lit(C.ERROR_ANSWER).alias("answer"))
    return hit.unionByName(miss).unionByName(failed)


def field_stats(all_votes: DataFrame) -> DataFrame:
    """Rows (fixture, field, n_votes, n_match, majority, agreement, n_answers): a strict majority of matches; the most common answer's share."""
    counts = all_votes.groupBy("fixture", "field", "answer").agg(F.count("*").alias("n"))
    out = counts.groupBy("fixture", "field").agg(F.sum("n").alias("n_votes"), F.sum(F.when(F.col("answer") == C.MATCH_ANSWER, F.col("n")).otherwise(0)).alias("n_match"), F.max("n").alias("top"), F.count("*").alias("n_answers"))
    return out.select("fixture", "field", "n_votes", "n_match", (F.col("n_match") * 2 > F.col("n_votes")).alias("majority"), (F.col("top") / F.col("n_votes")).alias("agreement"), "n_answers")


def verdicts(evaluations: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows (fixture, verdict, known_limitation, disagrees): error, unscored, pass or `fail: ` and its fields in their order."""
    files = evaluations.groupBy("fixture").agg(F.bool_and(F.col("error").isNotNull()).alias("all_failed"), F.min_by("known_limitation", "repeat").alias("known_limitation"))
    bad = F.array_sort(F.collect_list(F.when(~F.col("majority"), F.struct(field_order(F.col("field")).alias("o"), "field"))))
    per = stats.groupBy("fixture").agg(F.transform(bad, lambda x: x["field"]).alias("failing"), F.bool_or(F.col("n_answers") > 1).alias("disagrees"))
    out = files.join(per, "fixture", "left")
    verdict = F.when(F.col("all_failed"), "error").when(F.col("failing").isNull(), "unscored").when(F.size("failing") > 0, F.concat(F.lit("fail: "), F.array_join("failing", ", "))).otherwise("pass")
    return out.select("fixture", verdict.alias("verdict"), "known_limitation", F.coalesce("disagrees", F.lit(False)).alias("disagrees"))


def repeat_stats(evaluations: DataFrame) -> dict[str, Any]:
    """Majority score, majority and agreement by field, disagreeing fixtures and verdicts of a run. Known limitations and fixtures that all failed only have a verdict."""
    stats = field_stats(votes(evaluations))
    judged = verdicts(evaluations, stats)
    own = stats.join(judged.where(~F.col("known_limitation") & ~F.col("verdict").isin("error", "unscored")).select("fixture"), "fixture", "left_semi")
    told = judged.collect()  # one row a fixture: the report lists them
    by_field = {r["field"]: r for r in own.groupBy("field").agg(F.avg(F.col("majority").cast("double")).alias("m"), F.avg("agreement").alias("a")).collect()}
    score = own.groupBy("fixture").agg(F.avg(F.col("majority").cast("double")).alias("s")).agg(F.avg("s").alias("s")).first()["s"]
    return {
        "majority_score": score, "field_majority_scores": {f: by_field[f]["m"] for f in C.COMPARABLE_FIELDS if f in by_field}, "field_agreement": {f: by_field[f]["a"] for f in C.COMPARABLE_FIELDS if f in by_field},
        "disagreeing_fixtures": sorted(r["fixture"] for r in told if r["disagrees"]), "fixture_verdicts": {r["fixture"]: r["verdict"] for r in sorted(told, key=lambda r: r["fixture"])},
    }


def field_scores(evaluations: DataFrame) -> DataFrame:
    """Rows (field, score): matched by compared over lines without error or known limitation."""
    own = evaluations.where(F.col("error").isNull() & ~F.col("known_limitation"))
    both = own.select(F.explode("matched").alias("field"), F.lit(1.0).alias("hit")).unionByName(own.select(F.explode(F.transform("mismatched", lambda m: m["field"])).alias("field"), F.lit(0.0).alias("hit")))
    return both.groupBy("field").agg(F.avg("hit").alias("score"))


def latencies(rows: DataFrame, by: str, seconds: str) -> DataFrame:
    """Rows (by, p50, p95, slowest): exact percentiles, interpolated."""
    return rows.groupBy(by).agg(F.percentile(seconds, 0.5).alias("p50"), F.percentile(seconds, 0.95).alias("p95"), F.max(seconds).alias("slowest"))


def usage_totals(rows: DataFrame, by: str, tokens: str, retried: Column) -> DataFrame:
    """Rows (by, tokens, attempts, retries) of attempts: the sum of what was reported, null if nothing was."""
    return rows.groupBy(by).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("attempts"), F.count_if(retried).alias("retries"))


def error_class(message: Column) -> Column:
    return F.split_part(message, F.lit(":"), F.lit(1))


def transient_status(message: Column) -> Column:
    """429 or 503 in a message; else an empty string."""
    return F.regexp_extract(message, r"\b(429|503)\b", 1)


def scores_by(evaluations: DataFrame) -> DataFrame:
    """Rows (category, fixture, n, score): overall, by category and by fixture in one pass of GROUPING SETS."""
    own = evaluations.where(F.col("error").isNull() & ~F.col("known_limitation") & F.col("score").isNotNull())
    sets = [[], ["category"], ["fixture"]]
    return own.groupingSets([[F.col(c) for c in s] for s in sets], "category", "fixture").agg(F.count("*").alias("n"), F.avg("score").alias("score"))


def summarize(evaluations: DataFrame, run: dict[str, Any] | None = None) -> dict[str, Any]:
    """The summary of a run, its settings first. Percentiles are exact and interpolated; null where nothing was reported."""
    e = evaluations.withColumn("regular", F.col("error").isNull() & ~F.col("known_limitation"))
    u, mean = F.col("usage"), lambda c: F.avg(F.when(F.col("regular"), c))
    one = e.agg(
        F.countDistinct("fixture").alias("fixtures_run"), F.count("*").alias("lines"), F.count(F.when(F.col("regular"), F.col("score"))).alias("scored_lines"), F.count_if("known_limitation").alias("known_limitation_lines"),
        F.count_if(F.col("error").isNotNull() & ~F.col("known_limitation")).alias("errored_lines"), mean(F.col("score")).alias("aggregate_score"), mean(F.col("columns_recall")).alias("columns_recall_mean"),
        mean(F.col("columns_count_match").cast("double")).alias("columns_count_match_rate"), F.coalesce(F.sum(u["prompt_tokens"]), F.lit(0)).alias("prompt_total"), F.coalesce(F.sum(u["completion_tokens"]), F.lit(0)).alias("completion_total"),
        F.avg(u["prompt_tokens"]).alias("prompt_mean"), F.avg(u["completion_tokens"]).alias("completion_mean"), F.percentile("latency_seconds", 0.5).alias("p50"), F.percentile("latency_seconds", 0.95).alias("p95"),
        F.max(u["load_seconds"]).alias("load_max"), F.percentile(u["load_seconds"], 0.5).alias("load_p50"), F.sum("calls").alias("calls"), F.count_if(u["attempts"] > 1).alias("fallback_used"), F.sum("retries").alias("retries"),
    ).first()
    classes = e.where(F.col("error").isNotNull()).groupBy(error_class(F.col("error")).alias("k")).count().collect()
    messages = e.select(F.explode(F.map_values("attempt_errors")).alias("m"))
    tried = messages.groupBy(error_class(F.col("m")).alias("k"), transient_status(F.col("m")).alias("s")).count().collect()
    categories = e.where("regular").groupBy("category").agg(F.avg("score").alias("s")).where("s IS NOT NULL").orderBy("category").collect()
    fields = {r["field"]: r["score"] for r in field_scores(evaluations).collect()}
    attempts: dict[str, int] = {}
    for r in tried:
        attempts[r["k"]] = attempts.get(r["k"], 0) + r["count"]
    d = one.asDict()
    own = {k: d[k] for k in ("fixtures_run", "lines", "scored_lines", "known_limitation_lines", "errored_lines", "aggregate_score")}
    return (run or {}) | own | {"category_scores": {r["category"]: r["s"] for r in categories}, "field_scores": {f: fields[f] for f in C.COMPARABLE_FIELDS if f in fields}} | repeat_stats(evaluations) | {
        "columns_recall_mean": d["columns_recall_mean"], "columns_count_match_rate": d["columns_count_match_rate"], "tokens": {k: d[k] for k in ("prompt_total", "completion_total", "prompt_mean", "completion_mean")},
        "latency_seconds": {"p50": d["p50"], "p95": d["p95"]}, "load_seconds": {"max": d["load_max"], "p50": d["load_p50"]}, "calls": d["calls"], "fallback_used": d["fallback_used"], "retries": d["retries"],
        "errors": {r["k"]: r["count"] for r in classes}, "attempt_errors": attempts, "http_429": sum(r["count"] for r in tried if r["s"] == "429"), "http_503": sum(r["count"] for r in tried if r["s"] == "503"),
    }
