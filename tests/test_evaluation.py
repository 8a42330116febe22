"""Scores, votes, summaries, run files, guards, reports."""

import json

import pytest
from pyspark.sql import functions as F

from tabscout import cli, errors
from tabscout.operators import evaluation, guards, inspection, reports, runner
from tabscout.sources import runs


def line(fixture, repeat, matched=(), mismatched=(), error=None, known=False, latency=1.0, tokens=None, attempts=None, category="c"):
    return {
        "fixture": fixture, "category": category, "repeat": repeat, "known_limitation": known, "model_used": None if error else "m", "matched": list(matched), "mismatched": [{"field": f, "expected": e, "actual": a} for f, e, a in mismatched], "skipped": [],
        "score": None if error or not (matched or mismatched) else len(matched) / (len(matched) + len(mismatched)), "columns_recall": None if error else 1.0, "columns_count_match": None if error else True,
        "usage": None if error else {"model": "m", "prompt_tokens": tokens, "completion_tokens": None, "latency_seconds": latency, "attempts": 2 if attempts else 1, "retries": 0, "load_seconds": None, "prompt_version": "1"},
        "latency_seconds": latency, "calls": 1, "error": error, "attempt_errors": attempts or {}, "raw_response": [{"model": "m", "text": f"{fixture}{repeat}"}],
    }


LINES = [
    line("a", 1, ["delimiter", "columns"], latency=1.0, tokens=100), line("a", 2, ["delimiter", "columns"], latency=2.0, tokens=None), line("a", 3, ["delimiter"], [("columns", ["x"], ["y"])], latency=4.0, tokens=300),
    line("b", 1, ["delimiter"], [("columns", ["x"], ["y"])], attempts={"m0": "ModelTimeoutError: 429 slow"}), line("b", 2, ["delimiter"], [("columns", ["x"], ["z"])]), line("b", 3, error="InspectionFailedError: all"),
    line("k", 1, [], [("delimiter", ",", ";")], known=True), line("e", 1, error="EmptySampleError: empty"), line("u", 1, category="d"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("runs") / "run.jsonl"
    summary = {"aggregate_score": 0.5}
    path.write_text("\n".join(json.dumps(x) for x in [{"run": {"model": "m", "n_bytes": 4096, "tail_bytes": 4096}}, *LINES, {"summary": summary}]) + "\n\n")
    return str(path), runs.read(spark, str(path))


def test_run_file(spark, tables):
    path, t = tables
    assert t["evaluations"].count() == len(LINES) and t["run"].count() == 1 and t["bad"].count() == 0
    assert {r["retries"] for r in t["evaluations"].collect()} == {0}
    assert runs.load_summary(spark, path) == {"aggregate_score": 0.5}


def test_bad_run_files(spark, tmp_path):
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"run": {}}\nnot json\n')
    with pytest.raises(errors.RunFileError, match="line 2"):
        runs.load_summary(spark, str(bad))
    bad.write_text('{"run": {}}\n')
    with pytest.raises(errors.RunFileError, match="no summary"):
        runs.load_summary(spark, str(bad))


def test_lines_of_large_run_files(spark, tmp_path):
    """Files go over many tasks by split, and lines keep their numbers: blank ones, any breaks, several files."""
    expected = {}
    for name, n in (("a", 400), ("b", 3), ("c", 90)):
        lines = ["" if k % 11 == 3 else "\u2003 " if k % 11 == 5 else json.dumps({"fixture": f"{name}é{k}", "error": "x" * (k * 37 % 101)}, ensure_ascii=False) for k in range(n)]
        (tmp_path / f"{name}.jsonl").write_bytes("".join(x + ("\n", "\r\n", "\r")[k * k % 7 % 3] for k, x in enumerate(lines)).encode())
        expected |= {(f"{name}.jsonl", k + 1): x for k, x in enumerate(lines) if x.strip()}
    (tmp_path / "d.jsonl").write_text('\n{"\\u0073ummary": {"lines": 4}}')
    small = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "50"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        t = runs.read(spark, str(tmp_path))
        rows = runs.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8 and rows.rdd.getNumPartitions() > 8
        got = [((r["path"].rpartition("/")[2], r["line_no"]), r["line"]) for r in rows.where("path NOT LIKE '%d.jsonl'").collect()]
        assert len(got) == len(expected) and dict(got) == expected
        assert {(r["path"].rpartition("/")[2], r["line_no"]) for r in t["evaluations"].collect()} == set(expected)
        assert [(r["line_no"], r["s"]) for r in t["summary"].select("line_no", F.to_json("summary").alias("s")).collect()] == [(2, '{"lines":4}')]
        assert runs.evaluations(spark, str(tmp_path)).count() == len(expected)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_write_and_read_again(spark, tables, tmp_path):
    _, t = tables
    out = str(tmp_path / "again")
    runs.write(t["evaluations"].drop("path", "line_no"), out, {"model": "m"}, {"aggregate_score": 1.0})
    again = runs.read(spark, out)
    assert again["evaluations"].count() == len(LINES) and runs.load_summary(spark, out) == {"aggregate_score": 1.0}
    with pytest.raises(Exception, match="(?i)exists"):
        runs.write(t["evaluations"].drop("path", "line_no"), out, {})
    assert runs.output_path("r/{model}.jsonl", "a/b:1", "s") == "r/a-b-1.jsonl" and runs.output_path("r", "m", "s") == "r/m-s.jsonl"


def test_summary(tables):
    s = evaluation.summarize(tables[1]["evaluations"], {"model": "m"})
    assert s["lines"] == 9 and s["fixtures_run"] == 5 and s["scored_lines"] == 5 and s["errored_lines"] == 2 and s["known_limitation_lines"] == 1
    assert s["aggregate_score"] == pytest.approx((1 + 1 + 0.5 + 0.5 + 0.5) / 5)
    assert s["field_scores"] == {"delimiter": 1.0, "columns": pytest.approx(0.4)} and s["category_scores"] == {"c": pytest.approx(0.7)}
    assert s["tokens"] == {"prompt_total": 400, "completion_total": 0, "prompt_mean": 200.0, "completion_mean": None}
    assert s["latency_seconds"]["p50"] == 1.0 and s["fallback_used"] == 1 and s["http_429"] == 1 and s["http_503"] == 0
    assert s["errors"] == {"InspectionFailedError": 1, "EmptySampleError": 1} and s["attempt_errors"] == {"ModelTimeoutError": 1}
    assert s["fixture_verdicts"] == {"a": "pass", "b": "fail: columns", "e": "error", "k": "fail: delimiter", "u": "unscored"}
    assert s["disagreeing_fixtures"] == ["a", "b"]
    assert s["majority_score"] == pytest.approx(0.75) and s["field_majority_scores"] == {"delimiter": 1.0, "columns": 0.5}
    assert s["field_agreement"] == {"delimiter": pytest.approx((1 + 2 / 3) / 2), "columns": pytest.approx((2 / 3 + 1 / 3) / 2)}


def test_comparisons(spark):
    kind = "encoding string, delimiter string, quotechar string, escapechar string, doublequote boolean, has_header boolean, header_row_index int, footer_lines array<string>, footer_rows_to_skip int, columns array<string>"
    truth = ("latin-1 or cp1252 (not utf-8)", ",", None, None, None, True, 0, ["x "], None, ["a"])
    result = ("cp1252", ";", '"', None, True, True, 0, [" x"], 1, ["a"])
    nested = kind.replace(" ", ":").replace(",:", ",")
    manifest = spark.createDataFrame([("f", truth, ["encoding", "delimiter", "escapechar", "header_row_index", "footer_lines", "columns", "quotechar"])], f"fixture string, expected struct<{nested}>, present array<string>")
    got = {r["field"]: r["verdict"] for r in evaluation.comparisons(spark.createDataFrame([("f", result)], f"fixture string, result struct<{nested}>"), manifest).collect()}
    assert got == {"encoding": "matched", "delimiter": "mismatched", "escapechar": "matched", "header_row_index": "matched", "footer_lines": "matched", "columns": "matched", "quotechar": "skipped", "doublequote": "skipped", "has_header": "skipped", "footer_rows_to_skip": "skipped"}


def test_column_recall_is_a_multiset(spark):
    df = spark.createDataFrame([("a", ["x", "x", "y "], ["x", " y", "y"]), ("b", [], ["x"]), ("c", None, ["x"])], "fixture string, expected array<string>, actual array<string>")
    got = {r["fixture"]: (r["columns_recall"], r["columns_count_match"]) for r in evaluation.column_recall(df).collect()}
    assert got == {"a": (pytest.approx(2 / 3), True), "b": (None, False), "c": (None, None)}


def test_guards(spark):
    manifest = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "fixture string, category string")
    assert [r[0] for r in guards.select_fixtures(manifest, ["x"], first=1).collect()] == ["a"]
    with pytest.raises(ValueError, match="unknown fixtures: q"):
        guards.select_fixtures(manifest, names=["a", "q"])
    with pytest.raises(ValueError, match="no fixture"):
        guards.select_fixtures(manifest, ["z"])
    planned = spark.createDataFrame([(1, 4), (2, 4), (3, 1)], "n int, calls int")
    assert [r["n"] for r in guards.within_budget(planned, 7, "n", "calls").collect()] == [1]
    now, slept = [0.0], []
    limiter = guards.RateLimiter(3, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        limiter.wait(2)
        limiter.record(2)
    assert slept == [60.0, 60.0]
    budget = guards.CallBudget(3)
    budget.charge(2)
    assert budget.allows(1) and not budget.allows(2)


def test_replay(spark, tables):
    e = tables[1]["evaluations"]
    assert guards.replay_answers(e).count() == len(LINES)
    got = guards.replay(spark.createDataFrame([("a",), ("missing",)], "fixture string"), e.where("repeat = 1"), ["none", "m"]).collect()
    assert [(r["fixture"], r["replayed"][0]["text"]) for r in got] == [("a", "a1")]
    with pytest.raises(ValueError):
        guards.same_windows({"n_bytes": 1, "tail_bytes": 2}, 4096, 4096)


def test_reports(spark, tables):
    e = tables[1]["evaluations"]
    s = evaluation.summarize(e, {"model": "m"})
    wide = reports.table(spark, {"one": s, "two": {"aggregate_score": None, "category_scores": {"z": 1.0}}})
    rows = {r["metric"]: (r["one"], r["two"]) for r in wide.collect()}
    assert rows["aggregate score"] == ("70.0 %", "n/a") and rows["category: z"] == ("n/a", "100.0 %") and rows["latency p50"][0] == "1.00 s"
    before = spark.createDataFrame([("a", "pass"), ("b", "error")], "fixture string, verdict string")
    after = spark.createDataFrame([("a", "pass"), ("c", "pass")], "fixture string, verdict string")
    assert [tuple(r) for r in reports.verdict_changes(before, after).collect()] == [("b", "error", "not run"), ("c", "not run", "pass")]
    text = reports.run_report(e, s)
    assert "## Errors" in text and "EmptySampleError: empty" in text and text.endswith("Aggregate: 70.0 %\n")
    assert reports.label({"model": "m", "replay_of": "x"}, False) == "m (replay, incomplete)"


def test_evaluate_a_run(spark, tmp_path):
    """Files inspected by the heuristic become the lines of a run, are written, read and summed up."""
    from tabscout.operators import inspection

    kind = "struct<encoding:string,delimiter:string,quotechar:string,escapechar:string,doublequote:boolean,has_header:boolean,header_row_index:int,footer_lines:array<string>,footer_rows_to_skip:int,columns:array<string>>"
    files = [("good", b"Fecha;Cliente\n2024-01-01;x\n2024-01-02;y\n"), ("wrong", b"a,b\n1,2\n3,4\n"), ("empty", b""), ("surprise", b"a,b\n1,2\n3,4\n")]
    truth = lambda d, c: ("utf-8", d, None, None, None, True, 0, [], None, c)
    present = ["encoding", "delimiter", "escapechar", "has_header", "header_row_index", "footer_lines", "columns"]
    rows = [("good", "c", False, truth(";", ["Fecha", "Cliente"]), present, None), ("wrong", "c", False, truth(";", ["a"]), present, None), ("empty", "d", False, truth(None, None), [], "EmptySampleError"), ("surprise", "d", False, truth(",", ["a", "b"]), present, "EmptySampleError")]
    manifest = spark.createDataFrame(rows, f"fixture string, category string, known_limitation boolean, expected {kind}, present array<string>, expected_error string")
    done = inspection.inspect(spark, spark.createDataFrame([(n, bytearray(b)) for n, b in files], "fixture string, content binary"))
    lines = evaluation.evaluate(done, manifest).cache()
    got = {r["fixture"]: r for r in lines.collect()}
    assert got["good"]["score"] == 1.0 and got["good"]["columns_recall"] == 1.0 and got["good"]["calls"] == 1
    assert [m["field"] for m in got["wrong"]["mismatched"]] == ["delimiter", "columns"] and got["wrong"]["columns_recall"] == 1.0 and got["wrong"]["columns_count_match"] is False
    assert got["empty"]["matched"] == ["expected_error"] and got["empty"]["error"] is None and got["empty"]["calls"] == 0 and got["empty"]["score"] == 1.0
    assert [m["field"] for m in got["surprise"]["mismatched"]] == ["expected_error"]
    runs.write(lines, str(tmp_path / "run"), {"model": "heuristic"})
    again = evaluation.summarize(runs.read(spark, str(tmp_path / "run"))["evaluations"])
    assert again["fixture_verdicts"] == {"good": "pass", "wrong": "fail: delimiter, columns", "empty": "pass", "surprise": "fail: expected_error"} and again["lines"] == 4


EXPECTED = {"delimiter": ";", "has_header": True, "header_row_index": 0, "columns": ["id", "word"]}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A folder of four files and their manifest; the last is empty, and expected to be."""
    folder = tmp_path_factory.mktemp("files")
    for k in range(3):
        (folder / f"f{k}.csv").write_text("id;word\n" + "".join(f"{n};w{n}\n" for n in range(5 + k)))
    (folder / "none.csv").write_text("")
    entries = [{"filename": f"f{k}.csv", "category": "plain", "expected": EXPECTED, "subsets": ["quick"] if k else []} for k in range(3)] + [{"filename": "none.csv", "category": "odd", "expected": {}, "expected_error": "EmptySampleError"}]
    path = folder.parent / f"{folder.name}.json"
    path.write_text(json.dumps(entries))
    manifest = runner.load_manifest(spark, str(path))
    return str(folder), str(path), manifest, runner.fixture_windows(spark, str(folder), manifest)


def test_run_stops_before_the_budget(spark, files, tmp_path):
    """Each call is planned at its worst, two models, and charged as made, one: the empty file costs nothing."""
    _, _, manifest, windows = files
    out = str(tmp_path / "run")
    s = runner.run(windows, manifest, out, model="a", fallback="b", repeats=2, max_calls=5)
    t = runs.read(spark, out)
    assert [tuple(r) for r in t["evaluations"].orderBy("fixture", "repeat").select("fixture", "repeat").collect()] == [("f0.csv", 1), ("f0.csv", 2), ("f1.csv", 1), ("f1.csv", 2)]
    assert "max_calls 5" in s["stopped_early"] and s["calls"] == 4 and s["fixtures_planned"] == 4 and t["summary"].count() == 1
    whole = runner.run(windows, manifest, str(tmp_path / "whole"))
    assert whole["stopped_early"] is None and whole["lines"] == 4 and whole["aggregate_score"] == 1.0 and whole["errored_lines"] == 0
    with pytest.raises(Exception, match="(?i)exists"):
        runner.run(windows, manifest, out)


def test_rate_limited_run(spark, files, tmp_path):
    _, _, manifest, windows = files
    s = runner.run(windows, manifest, str(tmp_path / "slow"), per_minute=60)
    assert s["lines"] == 4 and s["calls"] == 3


def test_replay(spark, files, tmp_path):
    _, _, manifest, windows = files
    source = str(tmp_path / "source")
    runner.run(windows, manifest, source, max_calls=2, info={"backend": "offline"})
    s = runner.replay(windows, manifest, source, str(tmp_path / "again"))
    assert s["replay_of"] == source and s["replay_skipped"] == 2 and s["fixtures_run"] == 2 and s["aggregate_score"] == 1.0 and s["backend"] == "offline"
    for refused in ({"max_calls": 3}, {"per_minute": 1}, {"backend": "api"}, {"dry_run": True}):
        with pytest.raises(ValueError, match=next(iter(refused))):
            runner.replay(windows, manifest, source, str(tmp_path / "never"), **refused)
    with pytest.raises(ValueError, match="windows"):
        runner.replay(windows, manifest, source, str(tmp_path / "never"), head_bytes=17)
    with pytest.raises(ValueError, match="none of the fixtures"):
        runner.replay(windows, manifest.where("fixture = 'f2.csv'"), source, str(tmp_path / "never"))
    other = runner.replay(windows, manifest, source, str(tmp_path / "other"), model="unheard-of")
    assert other["errored_lines"] == 2  # nothing was recorded of that model
    bare = tmp_path / "bare.jsonl"
    bare.write_text(json.dumps({"run": {"model": "m", "n_bytes": 4096, "tail_bytes": 4096}}) + "\n")
    with pytest.raises(errors.RunFileError, match="no recorded answers"):
        runner.load_replay(spark, str(bare))


def test_interrupted_runs(spark, tmp_path):
    path = tmp_path / "cut.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in [{"run": {"model": "m", "fixtures_planned": 9}}, *LINES]) + "\n")
    s = runner.summarize_interrupted(spark, str(path))
    assert s["incomplete"] is True and s["stopped_early"] == "interrupted" and s["fixtures_planned"] == 9 and s["lines"] == len(LINES)
    assert runs.load_summary(spark, str(path))["aggregate_score"] == pytest.approx(s["aggregate_score"])
    with pytest.raises(errors.RunFileError, match="already"):
        runner.summarize_interrupted(spark, str(path))
    path.write_text(json.dumps(LINES[0]) + "\n")
    with pytest.raises(errors.RunFileError, match="no run line"):
        runner.summarize_interrupted(spark, str(path))


def test_commands(spark, files, tmp_path, capsys):
    folder, manifest, _, _ = files
    common = ["--no-env-file", "--backend", "offline"]
    assert cli.main(["run", manifest, folder, "--out", str(tmp_path / "one-{model}.jsonl"), "--subset", "quick", *common]) == 0
    one = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert one["summary"]["fixtures_run"] == 2
    assert cli.main(["replay", one["out"], manifest, folder, "--out", str(tmp_path / "two.jsonl"), "--no-env-file"]) == 0
    two = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert two["summary"]["replay_skipped"] == 2 and two["summary"]["replay_of"] == one["out"]
    assert cli.main(["replay", one["out"], manifest, folder, "--max-calls", "3"]) == 1 and "max_calls" in capsys.readouterr().err
    assert cli.main(["compare", one["out"], two["out"]]) == 0 and "aggregate score" in capsys.readouterr().out
    assert cli.main(["summarize", one["out"]]) == 1 and "already" in capsys.readouterr().err
    assert cli.main(["run", manifest, folder, "--dry-run", *common]) == 0 and json.loads(capsys.readouterr().out)["files"] == 4
    assert cli.main(["run", manifest, folder, "--name", "nosuch.csv", *common]) == 1 and "nosuch.csv" in capsys.readouterr().err


def test_budget_prefix_over_ranges(spark):
    """The sum goes over many ranges; ties of nothing, a file dearer than what is left ends the prefix."""
    calls = [(k, 1 + k * 7 % 5) for k in range(1000)]
    df = spark.createDataFrame(calls, "k long, calls long").repartition(7)
    total, expected = 0, {}
    for k, c in calls:
        total += c
        if total <= 800:
            expected[k] = total
    assert {r["k"]: r["used"] for r in guards.within_budget(df, 800, "k", "calls").collect()} == expected


def test_rate_window_is_brute_force(spark):
    rows = [(k, "hot" if k % 3 else None, 1_700_000_000 + k * k % 997) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, key string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r["k"]: r["n_recent"] for r in guards.rate_window(df, "key", "at", 60).collect()}
    assert got == {k: sum(a == key and s - 60 <= x <= s for _, a, x in rows) for k, key, s in rows}


def test_concurrent_coroutines(spark):
    """Files of a batch are under way at once when the invoker is a coroutine function."""
    import asyncio
    import time

    from tabscout.operators import invokers

    async def slow(prompt, model):
        await asyncio.sleep(0.5)
        return invokers.heuristic(prompt, model)

    rows = spark.createDataFrame([(k, b"id;word\n1;a\n2;b\n") for k in range(16)], "k long, content binary").coalesce(1)
    began = time.monotonic()
    out = inspection.inspect(spark, rows, invoker=slow).select("k", "result.delimiter", "error").collect()
    assert len(out) == 16 and {r["delimiter"] for r in out} == {";"} and time.monotonic() - began < 6
