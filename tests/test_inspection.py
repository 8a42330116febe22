"""Sampling, answers, grounding, calls and reading, end to end with offline invokers."""

import io
import json
import time

import pytest
from pyspark.sql import functions as F

from tabscout import errors, settings
from tabscout.operators import answers, grounding, inspection, invokers, reading, sampling
from tabscout.sources import env, fixtures, windows

ROWS = [("2024-01-01", "Acme", "x 1", "12.50"), ("2024-01-02", "Bolt", "y 2", "7.00"), ("2024-01-03", "Core", "z 3", "1.25"), ("2024-01-04", "Dyna", "w 4", "3.00")]
BODY = "\n".join(";".join(r) for r in ROWS)


def answer(**changes):
    return {"encoding": "utf-8", "delimiter": ";", "quotechar": '"', "escapechar": None, "doublequote": True, "has_header": True, "header_row_index": 0, "footer_first_line": None, "columns": ["Fecha", "Cliente", "Concepto", "Importe"], "confidence": 0.9} | changes


def grounded(spark, text, **changes):
    df = spark.createDataFrame([(bytearray(text.encode()), json.dumps(answer(**changes)))], "content binary, raw string")
    rows = sampling.sample(sampling.windows_of(df)).withColumn("p", answers.parsed(F.col("raw"))).withColumn("answer", F.col("p.answer")).drop("content", "raw", "p")
    return grounding.ground(rows).select("result.*").first().asDict(recursive=True)


def test_header_is_located_past_a_preamble(spark):
    r = grounded(spark, "# export\n\nFecha;Cliente;Concepto;Importe\n" + BODY, columns=["Fecha", "Client", "Concept", "Amount"])
    assert (r["header_row_index"], r["columns"], r["has_header"]) == (2, ["Fecha", "Cliente", "Concepto", "Importe"], True)


def test_data_in_row_0_is_no_header(spark):
    r = grounded(spark, BODY, columns=["a", "b", "c", "d"])
    assert (r["has_header"], r["header_row_index"], r["columns"]) == (False, None, ["column_1", "column_2", "column_3", "column_4"])


def test_no_header_answer_that_names_a_line(spark):
    r = grounded(spark, "Fecha;Cliente;Concepto;Importe\n" + BODY, has_header=False, header_row_index=None)
    assert (r["has_header"], r["header_row_index"]) == (True, 0)


def test_blank_names_and_spaces_are_restored(spark):
    r = grounded(spark, ";Cliente; Concepto;Importe\n" + BODY, columns=["Cliente", "Concepto", "Importe"])
    assert r["columns"] == ["", "Cliente", " Concepto", "Importe"]


def test_one_column_file(spark):
    r = grounded(spark, "name\nann\nbob\n", delimiter="|", columns=["name", "other"])
    assert (r["delimiter"], r["columns"], r["header_row_index"]) == (",", ["name"], 0)
    assert grounded(spark, "ann\nbob\n", columns=["x", "y"], header_row_index=None, has_header=False)["columns"] == ["column_1"]


@pytest.mark.parametrize("reported, text, expected", [(",", "a;b,c\nd;e\nf;g\n", ";"), (";", "a;b\nc;d\n", ";"), (",", "a,b;c\nd,e;f\n", ","), ("|", "a b\nc d\n", ","), (",", "a;b\tc\nd;e\tf\n", ",")])
def test_delimiter(spark, reported, text, expected):
    assert grounded(spark, text, delimiter=reported, columns=["a", "b"])["delimiter"] == expected


FOOT = "\n\n--- Fin ---\nGenerado 2024\n"


@pytest.mark.parametrize("anchor, lines", [("--- Fin ---", ["", "--- Fin ---", "Generado 2024"]), ("Generado 2024", ["", "--- Fin ---", "Generado 2024"]), ("", ["", "--- Fin ---", "Generado 2024"]), (";".join(ROWS[-1]), ["", "--- Fin ---", "Generado 2024"]), ("not there at all", []), (None, [])])
def test_footer(spark, anchor, lines):
    r = grounded(spark, "Fecha;Cliente;Concepto;Importe\n" + BODY + FOOT, footer_first_line=anchor)
    assert (r["footer_lines"], r["footer_rows_to_skip"]) == (lines, len(lines))


def test_totals_footer_copied_with_another_delimiter(spark):
    r = grounded(spark, "Fecha;Cliente;Concepto;Importe\n" + BODY + "\nTOTAL;;;23.75\n", delimiter=",", footer_first_line="TOTAL,,,23.75")
    assert (r["delimiter"], r["footer_lines"]) == (";", ["TOTAL;;;23.75"])


def test_footer_of_a_long_file_is_read_from_the_tail(spark):
    text = "Fecha;Cliente;Concepto;Importe\n" + "\n".join(";".join(ROWS[k % 4]) for k in range(900)) + "\nTOTAL;;;1\n"
    assert grounded(spark, text, footer_first_line="TOTAL;;;1")["footer_lines"] == ["TOTAL;;;1"]


@pytest.mark.parametrize("text, given, expected", [
    ('a;b\n"x\\"y";1\n', (None, True), ("\\", False)), ('a;b\n"x""y";1\n', ("\\", False), (None, True)), ('a;b\n"x";1\n', ("\\", False), (None, False)), ("a;b\nx;1\n", ("\\", False), ("\\", False)), ('a;b\n"";1\n', ("\\", False), ("\\", False)),
])
def test_quote_escaping(spark, text, given, expected):
    r = grounded(spark, text, escapechar=given[0], doublequote=given[1], columns=["a", "b"])
    assert (r["escapechar"], r["doublequote"]) == expected


def test_quotechar_that_never_occurs(spark):
    assert grounded(spark, "a;b\n1;2\n", quotechar="'", columns=["a", "b"])["quotechar"] == '"'


@pytest.mark.parametrize("raw, reported, expected", [(b"\xef\xbb\xbfa;b\n1;2\n", "utf-8", "utf-8-sig"), (b"a;b\n1;2\n", "klingon", "utf-8"), (b"a;b\n1;2\n", "UTF8", "UTF8"), (b"a;b\n\xe9;2\n", "latin-1", "latin-1")])
def test_encoding(spark, raw, reported, expected):
    df = spark.createDataFrame([(bytearray(raw), json.dumps(answer(encoding=reported, columns=["a", "b"])))], "content binary, raw string")
    rows = sampling.sample(sampling.windows_of(df)).withColumn("answer", answers.parsed(F.col("raw"))["answer"]).drop("content")
    r = grounding.ground(rows).select("result.*").first()
    assert r["encoding"] == expected and r["columns"] == ["a", "b"]


@pytest.mark.parametrize("changes, expected", [
    ({"header_row_index": -1, "has_header": False}, {"header_row_index": None}), ({"confidence": 90}, {"confidence": 0.9}), ({"delimiter": "tab"}, {"delimiter": "\t"}), ({"delimiter": "\\t"}, {"delimiter": "\t"}), ({"delimiter": "\r\n"}, {"delimiter": ","}),
    ({"quotechar": "none", "escapechar": "null"}, {"quotechar": '"', "escapechar": None}), ({"escapechar": '"', "doublequote": False}, {"escapechar": None, "doublequote": True}), ({"footer_first_line": "\n \nfoot\nmore"}, {"footer_first_line": "foot"}),
    ({"columns": [" a ", "", "a"]}, {"columns": ["a", "", "a"]}), ({"has_header": True, "header_row_index": None}, {"header_row_index": 0}), ({"header_row_index": "2"}, {"header_row_index": 2}), ({"extra": 1}, {}),
])
def test_lenient_answers(changes, expected):
    got = answers.parse("Sure:\n```json\n" + json.dumps(answer(**changes)) + "\n```")
    assert {k: got[k] for k in expected} == expected


@pytest.mark.parametrize("changes", [{"delimiter": ";;"}, {"quotechar": ";"}, {"escapechar": ";"}, {"quotechar": "\n"}, {"has_header": False, "header_row_index": 1}, {"header_row_index": -2}, {"confidence": 101}, {"confidence": float("nan")}, {"columns": []}, {"columns": [1]}, {"encoding": None}])
def test_strict_answers(changes):
    with pytest.raises(errors.SchemaValidationError):
        answers.parse(json.dumps(answer(**changes)))


def test_missing_fields_and_no_json():
    bare = {k: v for k, v in answer().items() if k not in ("has_header", "quotechar", "escapechar", "doublequote")}
    assert answers.parse(json.dumps(bare))["has_header"] is True
    with pytest.raises(errors.SchemaValidationError):
        answers.parse(json.dumps({k: v for k, v in answer().items() if k != "header_row_index"}))
    with pytest.raises(errors.ResponseParsingError):
        answers.parse("no idea")


@pytest.mark.parametrize("n, head, tail, omitted", [(25, 25, None, 0), (26, 15, 10, 1), (60, 15, 10, 35), (0, 0, None, 0)])
def test_line_bounds(spark, n, head, tail, omitted):
    t = "".join(f"line {k}\n" for k in range(n))
    r = spark.createDataFrame([(t,)], "t string").select(sampling.bounded(F.col("t"), F.lit(None).cast("string"), F.lit(True)).alias("b")).select("b.*").first()
    assert (r["head_text"].count("\n"), r["tail_text"] and r["tail_text"].count("\n"), r["lines_omitted"]) == (head, tail, omitted)


class Forward(io.RawIOBase):
    """A stream that can't be sought and gives a few bytes at a time."""

    def __init__(self, data):
        self.data = io.BytesIO(data)

    def readable(self):
        return True

    def read(self, n=-1):
        return self.data.read(min(n, 7))


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 600, 5000])
def test_sources_agree(spark, tmp_path, size):
    data = bytes(i % 251 for i in range(size))
    path = tmp_path / "f.csv"
    path.write_bytes(data)
    row = windows.read(spark, str(path), 512, 100).first()
    own = sampling.windows_of(spark.createDataFrame([(bytearray(data),)], "content binary"), "content", 512, 100).first()
    stream = io.BytesIO(b"skip" + data)
    stream.seek(4)
    assert windows.stream_windows(stream, 512, 100) == (data[:512], data[512:][-100:], size) and stream.tell() == 4
    assert (bytes(row["head"]), bytes(row["tail"]), row["size"]) == (data[:512], data[512:][-100:], size) == (bytes(own["head"]), bytes(own["tail"]), own["size"])
    assert windows.stream_windows(Forward(data), 512, 100)[:2] == (data[:512], data[512:][-100:])


def test_forward_scan_limit_and_bad_streams():
    assert windows.stream_windows(Forward(b"x" * 3000), 512, 100, scan_limit=1000)[1:] == (None, None)
    with pytest.raises(TypeError):
        windows.stream_windows(io.StringIO("text"), 10, 10)


def test_unread_and_empty_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "good.csv").write_text("Fecha;Cliente\n2024-01-01;x\n2024-01-02;y\n")
    got = {r["path"].rsplit("/", 1)[1]: r for r in inspection.inspect(spark, str(tmp_path)).collect()}
    assert got["empty.csv"]["error"]["class"] == "EmptySampleError" and got["good.csv"]["result"]["columns"] == ["Fecha", "Cliente"]
    with pytest.raises(errors.EmptySampleError):
        inspection.inspect_one(spark, b"")
    with pytest.raises(TypeError):
        inspection.inspect(spark, 3)
    with pytest.raises(errors.FileSampleReadError):
        inspection.inspect(spark, str(tmp_path / "missing.csv"))


SPECS = {
    "plain": fixtures.Spec(), "semicolon": fixtures.Spec(";", preamble=("banner",), footer="totals"), "tab": fixtures.Spec("\t", newline="\r\n", footer="marker"), "pipe": fixtures.Spec("|", preamble=("a", "b", "", "c"), footer="blank_totals"),
    "bom": fixtures.Spec(",", bom=True, quote_header=True), "headerless": fixtures.Spec(";", header=False, footer="timestamp"),
}


@pytest.mark.parametrize("name", sorted(SPECS))
def test_fixtures_round_trip(spark, tmp_path, name):
    """Rendered, inspected by the heuristic, compared with the truth, and read back."""
    rows = [(1, f"2024-01-{k % 28 + 1:02d}", f"Name {k}, or so", f"{k}.50") for k in range(90)]
    df = spark.createDataFrame([(g, k, *r) for k, (g, *r) in enumerate(rows)], "g int, k int, date string, name string, amount string")
    spec = SPECS[name]
    text = fixtures.render(df, "g", "k", ["date", "name", "amount"], spec).first()["text"]
    truth = fixtures.manifest({name: spec}, ["date", "name", "amount"])[0]["expected"]
    path = tmp_path / f"{name}.csv"
    path.write_bytes(text.encode())
    got = inspection.inspect_one(spark, str(path))
    for k, v in truth.items():
        assert got[k] == v, (k, got[k], v)
    assert [tuple(r) for r in reading.read_rows(path.read_bytes(), got)] == [tuple(r[1:]) for r in rows]
    back = reading.read_delimited(spark, str(path), got)
    assert back.columns == truth["columns"] and [tuple(r) for r in back.collect()] == [tuple(r[1:]) for r in rows]


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    """A file of many splits, read without a sort: banner and footer go, all else stays in order."""
    path = tmp_path / "long.csv"
    path.write_text("\ufeffbanner\nid;word\n" + "".join(f"{k};w{k}\n" for k in range(40_000)) + "TOTAL;1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        r = {"encoding": "utf-8-sig", "delimiter": ";", "quotechar": '"', "escapechar": None, "doublequote": True, "has_header": True, "header_row_index": 1, "footer_rows_to_skip": 1, "columns": ["id", "word"]}
        out = reading.read_delimited(spark, str(path), r)
        assert out.rdd.getNumPartitions() > 5
        assert [tuple(x) for x in out.collect()] == [(str(k), f"w{k}") for k in range(40_000)]
        n = reading.numbered_lines(spark, str(path)).agg(F.min("n"), F.max("n"), F.max("total"), F.countDistinct("n")).first()
        assert tuple(n) == (0, 40_002, 40_003, 40_003)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_listed_files_are_read_by_range(spark, tmp_path):
    """As in stores that Arrow opens; the list comes from Spark, which leaves empty files out."""
    for k, size in enumerate((0, 511, 5000)):
        (tmp_path / f"{k}.bin").write_bytes(bytes(i % 251 for i in range(size)))
    got = {r["path"][-5:]: (r["size"], bytes(r["head"]), bytes(r["tail"] or b""), r["read_error"]) for r in windows.listed(spark, f"file://{tmp_path}/*.bin", 512, 100).collect()}
    data = bytes(i % 251 for i in range(5000))
    assert got == {"1.bin": (511, data[:511], b"", None), "2.bin": (5000, data[:512], data[-100:], None)}
    assert [tuple(r)[1:] for r in windows.listed(spark, f"file://{tmp_path}/0.bin", 512, 100).collect()] == [(0, b"", b"", None)]


def test_read_with_python_codec(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes("# x\nnaïve;b\né;2\n".encode("cp1252"))
    r = {"encoding": "cp1252", "delimiter": ";", "quotechar": '"', "escapechar": None, "doublequote": True, "has_header": True, "header_row_index": 1, "footer_rows_to_skip": 0, "columns": ["naïve", "b"]}
    assert [tuple(x) for x in reading.read_delimited(spark, str(path), r).collect()] == [("é", "2")]


def test_fallback_errors_and_usage():
    good = json.dumps(answer())

    def invoker(prompt, model):
        if model == "bad":
            raise RuntimeError("secret-key is wrong")
        return invokers.Reply(good if model == "good" else "nonsense", prompt_tokens=10)

    out = invokers.attempted("p", invoker, ["weak", "good"])
    assert out["raw"] == good and out["usage"]["attempts"] == 2 and out["usage"]["prompt_tokens"] == 20 and out["usage"]["model"] == "good"
    failed = invokers.attempted("p", invoker, ["bad", "weak"], secret="secret-key")
    assert failed["error"]["class"] == "InspectionFailedError" and "secret-key" not in str(failed) and set(failed["error"]["attempts"]) == {"bad", "weak"}
    assert invokers.candidates("a", "a") == ["a"]


def test_timeouts():
    out = invokers.attempted("p", lambda p, m: time.sleep(5), ["slow"], budget=0.05)
    assert out["error"]["class"] == "InspectionTimeoutError"

    async def slow(prompt, model):
        import asyncio

        await asyncio.sleep(5)

    assert invokers.attempted("p", slow, ["slow"], budget=0.05)["error"]["class"] == "InspectionTimeoutError"
    clock = iter([0.0, 0.0, 0.0, 100.0])
    d = invokers.Deadline(10, lambda: next(clock))
    assert d.share(last=False) == 7.0 and d.share(last=True) == 10.0 and d.spent


def test_retry_once_on_a_transient_status():
    class Busy(Exception):
        pass

    calls, waits = [], []

    def call(prompt, model):
        calls.append(model)
        if len(calls) == 1:
            raise Busy
        return "text"

    reply = invokers.with_retry(call, lambda e: (429, 2.0), sleep=waits.append)("p", "m")
    assert reply.retries == 1 and waits == [2.0]
    calls.clear()
    with pytest.raises(Busy):
        invokers.with_retry(call, lambda e: (429, 60.0), sleep=waits.append)("p", "m")


def test_replaying_and_recording():
    seen = []
    invoker = invokers.recording(invokers.Replaying([{"model": "a", "text": "1"}, {"model": "b", "text": "2"}, {"model": "a", "text": "3"}]), lambda p, m, t: seen.append((m, t)))
    assert [invoker("p", m) for m in ("a", "a", "b")] == ["1", "3", "2"] and seen == [("a", "1"), ("a", "3"), ("b", "2")]
    with pytest.raises(errors.ReplayMissError):
        invoker("p", "a")


def test_settings(tmp_path):
    path = tmp_path / ".env"
    path.write_text("﻿export LLM_BACKEND='API' # x\nAPI_KEY=\"k v\"\nAPI_MODEL=m1 # comment\n#X=1\nLOCAL_HOST=\n", encoding="utf-8")
    s = settings.load({"api_model": "m2"}, str(path))
    assert (s.llm_backend, s.api_key, s.api_model, s.local_host) == ("api", "k v", "m2", None) and "k v" not in repr(s) and s.ready()
    with pytest.raises(errors.CredentialsNotConfiguredError):
        settings.Settings(llm_backend="api", api_model="m").ready()
    assert env.read_env(str(tmp_path / "none")) == {}
    with pytest.raises(ValueError):
        settings.check_request(n_bytes=100)
    with pytest.raises(PermissionError):
        settings.check_request(model="m")


def test_status_of_errors():
    assert errors.status_of(errors.InspectionTimeoutError("x"))[0] == 504 and errors.status_of(errors.CredentialsNotConfiguredError("x"))[0] == 503 and errors.status_of(ValueError())[0] == 500
