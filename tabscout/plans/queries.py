"""Queries over the driver's tables, one or more for each kind of operator, over whole tables.

Rendered texts are the ground truth: rows of a table are written as delimited text with known quirks, and
what the operators find is compared with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscout import constants as C
from tabscout.functions import codecs, fields, text
from tabscout.operators import answers, evaluation, grounding, guards, inspection, prompts, reading, reports, runner, sampling
from tabscout.sources import fixtures, runs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- lines and windows


def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).cast("long").alias("n_lines"))


def line_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sampling.bounded(F.col("text"), F.lit(None).cast("string"), F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", b.alias("b"))
    return rows.select("doc_id", F.md5("b.head_text").alias("head_md5"), F.md5(F.coalesce("b.tail_text", F.lit("-"))).alias("tail_md5"), F.col("b.lines_omitted").cast("long").alias("lines_omitted"))


def trim_to_last_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.trim_to_break(F.col("text"))).cast("long").alias("n_chars_kept"))


def byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.windows_of(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content")))
    out = sampling.sample(rows)
    return out.select("doc_id", "size", F.octet_length("head").cast("long").alias("head_bytes"), F.octet_length("tail").cast("long").alias("tail_bytes"), "covers_whole_file", "encoding")


def encoding_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ["UTF8", "utf-8", "latin-1", "ISO-8859-1", "cp1252", "windows-1252", "UTF-16", "utf_16_le", "ascii", "US-ASCII", "utf-8-sig", "no such codec"]
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    return rows.select("label", codecs.canonical(F.col("label")).alias("codec"), codecs.unit_size(F.col("label")).cast("long").alias("unit"))


def tail_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.lit(1) + F.pmod("doc_id", F.lit(3))).alias("u"))
    unit = F.when(F.col("u") == 3, 4).otherwise(F.col("u"))
    return rows.select("doc_id", codecs.tail_window(F.greatest(F.col("n_chars") - 4096, F.lit(0)), F.lit(4095), unit).cast("long").alias("window"))


def utf8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    starts = F.filter(F.sequence(F.lit(0), F.octet_length("b"), F.lit(1000)), lambda at: at < F.octet_length("b"))
    blocks = F.transform(starts, lambda at: F.substring(F.col("b"), at + 1, F.lit(1000)))
    good = F.size(F.filter(blocks, codecs.utf8_suffix)).cast("long")
    return rows.select("doc_id", F.size(blocks).cast("long").alias("n_blocks"), good.alias("n_suffixes"))


# ---------------------------------------------------------------- fields, delimiters, shapes


def delimiter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    tried = F.array(*(F.lit(d) for d in C.CANDIDATE_DELIMITERS))
    rows = rows.select("doc_id", tried.alias("d"), fields.field_counts(text.lines(F.col("text")), tried, F.lit('"')).alias("n"))
    scored = rows.select("doc_id", F.explode(F.zip_with("d", "n", lambda d, n: F.struct(d.alias("delimiter"), text.modal_width(n).alias("m")))).alias("s"))
    return scored.select("doc_id", "s.delimiter", F.col("s.m.agreeing").cast("long").alias("agreeing"), F.col("s.m.width").cast("long").alias("width"))


def delimiter_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    tried = F.concat(F.array(F.lit(";")), F.array(*(F.lit(d) for d in C.CANDIDATE_DELIMITERS)))
    rows = rows.select("doc_id", "text", tried.alias("d"), fields.field_counts(text.lines(F.col("text")), tried, F.lit('"')).alias("n"))
    scores = F.zip_with("d", "n", lambda d, n: F.struct(d.alias("delimiter"), text.modal_width(n)["agreeing"].alias("agreeing")))
    chosen = grounding.delimiter(F.lit(";"), scores, F.contains("text", F.lit(";")), F.array(F.lit('"')))
    return rows.select("doc_id", chosen.alias("delimiter"))


def split_fields_rfc4180(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    cells = [F.col("c_custkey").cast("string"), F.concat(F.lit('say "'), "c_name", F.lit('"')), F.concat("c_mktsegment", F.lit(", etc.")), F.lit("")]
    rows = rows.select("c_custkey", F.array(fixtures.row(cells, ",")).alias("lines"))
    split = F.get(fields.split_rows(F.col("lines"), F.lit(","), F.lit('"')), F.lit(0))
    rows = rows.select("c_custkey", split.alias("f"))
    return rows.select("c_custkey", F.size("f").cast("long").alias("n"), F.get("f", F.lit(1)).alias("f1"), F.get("f", F.lit(2)).alias("f2"), F.get("f", F.lit(3)).alias("f3"))


def delimited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("tabscout_documents")
    return spark.sql("SELECT d.doc_id, CAST(max(l.line_no) + 1 AS BIGINT) AS n_lines, CAST(sum(size(l.fields)) AS BIGINT) AS n_fields FROM tabscout_documents d, LATERAL delimited_lines(d.text, '|', '~') l GROUP BY d.doc_id")


def _order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("a"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("b"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("c"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("d"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.col("o_orderstatus")).alias("e"),
    )


def field_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), text.field_shape(F.col(f)).alias("shape")) for f in "abcde"))
    rows = _order_fields(spark, sf_dir).select(F.explode(pairs).alias("p")).select("p.*")
    return rows.groupBy("field", "shape").agg(F.count("*").alias("n"))


def rows_look_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_fields(spark, sf_dir).select("o_orderkey", F.array("a", "b", "c", "d", "e").alias("f"))
    pairs = rows.withColumn("g", F.lead("f").over(Window.partitionBy(F.floor(F.col("o_orderkey") / 64)).orderBy("o_orderkey"))).where("g IS NOT NULL")
    return pairs.select("o_orderkey", text.look_alike(F.col("f"), F.col("g")).alias("alike"))


def positional_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(text.positional(F.col("n_nationkey") % 5), ",").alias("names"))


def totals_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with parts' names and containers, some put after a label word."""
    k = F.col("p_partkey")
    pick = lambda items, by: F.element_at(F.array(*(F.lit(x) for x in items)), (F.pmod(F.floor(k / by), F.lit(len(items))) + 1).cast("int"))
    label = F.concat(pick(("", "sub", "Sub-", "GRAND ", "sub - ", "'"), 1), pick(("total", "Totals", "suma", "SUM", "totales", "net", "summit"), 6), pick(("", ":", " general", "d", " :", ";"), 42))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 9 == 0, F.col("p_name")).otherwise(label).alias("label"), F.col("p_type").alias("rest"))
    line = F.concat("label", F.lit(";"), "rest")
    return rows.select("p_partkey", text.has_totals_label(line).alias("labelled"), text.is_totals_label(F.col("label")).alias("bare"))


def quote_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = text.quote_evidence(F.col("html"), F.lit(" "), F.lit('"'))
    return table(spark, sf_dir, "pages").select("page_id", e.alias("e")).select("page_id", "e.*")


# ---------------------------------------------------------------- answers


def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("So: "), "props", F.lit(" as asked."))).otherwise(F.concat(F.lit("  "), "props", F.lit("\n")))
    rows = rows.select("event_id", answers.payload_column(reply).alias("payload"))
    return rows.select("event_id", "payload", F.get_json_object("payload", "$.k").cast("long").alias("k"))


def dialect_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["tab", "\\t", "TAB", ",", "\n", "null", "none", "", " ", "'", None]
    rows = spark.createDataFrame(list(enumerate(values)), "n long, value string")
    return rows.select("n", *(answers.spelt(f, F.col("value")).alias(f) for f in ("delimiter", "quotechar", "escapechar")))


def answer_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    a = F.struct(
        F.when(i % 5 == 0, ";;").otherwise(",").alias("delimiter"), F.when(i % 7 == 0, ",").otherwise('"').alias("quotechar"), F.when(i % 11 == 0, '"').alias("escapechar"), (i % 2 == 0).alias("has_header"),
        F.when(i % 4 == 0, F.lit(0)).when(i % 13 == 0, F.lit(-1)).cast("int").alias("header_row_index"), (F.col("value") / 100).alias("confidence"), F.when(i % 17 == 0, F.expr("CAST(array() AS array<string>)")).otherwise(F.array(F.lit("a"))).alias("columns"),
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(answers.violations(a)), ",").alias("broken"))


def answers_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.concat(
        F.lit('{"encoding": "utf-8", "delimiter": "'), F.when(i % 3 == 0, "tab").otherwise(";"), F.lit('", "has_header": true, "header_row_index": '), F.when(i % 4 == 0, "null").otherwise((i % 3).cast("string")),
        F.lit(', "footer_first_line": null, "columns": [" a", "b "], "confidence": '), (i % 120).cast("string"), F.when(i % 10 == 9, "").otherwise("}"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", answers.parsed(raw).alias("p"))
    return rows.select("event_id", F.col("p.answer.delimiter").alias("delimiter"), F.col("p.answer.header_row_index").cast("long").alias("header_row_index"), F.array_join("p.answer.columns", "|").alias("columns"), F.col("p.answer.confidence").alias("confidence"), F.col("p.error.class").alias("error"))


# ---------------------------------------------------------------- prompts, calls, usage


def prompt_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.length("text")
    reply = prompts.reply_tokens((F.col("doc_id") % 60).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", prompts.estimated_tokens(chars).alias("tokens"), reply.cast("long").alias("reply"), prompts.context_size(chars, reply).cast("long").alias("context"))


def dry_run_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"), F.sum(prompts.estimated_tokens(F.length("text"))).alias("tokens"))


def usage_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").withColumn("reported", F.when(F.col("l_linenumber") % 2 == 0, q))
    return evaluation.usage_totals(rows, "l_orderkey", "reported", F.col("l_linenumber") > 1)


def call_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = table(spark, sf_dir, "customer").select("c_custkey", (guards.worst_case(F.col("c_nationkey") % 2 + 1, True)).cast("long").alias("calls"))
    return guards.within_budget(planned, 1000, "c_custkey", "calls").select("c_custkey", "used")


def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.rate_window(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts").select("event_id", "n_recent")


# ---------------------------------------------------------------- inspection of rendered texts


def rendered_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each nation: two banner lines, header, its customers, a blank line and totals; the delimiter goes by key."""
    d = F.element_at(F.array(*(F.lit(x) for x in (",", ";", "\t", "|"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    names = ["custkey", "name", "balance", "segment"]
    cells = [F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.col("c_mktsegment")]
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", d.alias("d"), fixtures.row(cells, d).alias("line"))
    one = rows.groupBy("c_nationkey", "d").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))).alias("x"), F.count("*").alias("n"))
    head = F.array(F.concat(F.lit("Customers of nation "), F.col("c_nationkey").cast("string")), F.lit("# for internal use"), F.concat_ws("", *(p for k, c in enumerate(names) for p in ([F.col("d")] if k else []) + [F.lit(c)])))
    foot = F.array(F.lit(""), F.concat(F.lit("TOTAL"), F.col("d"), F.col("d"), F.col("n").cast("string"), F.col("d")))
    whole = F.concat(F.array_join(F.concat(head, F.transform("x", lambda r: r["line"]), foot), "\n"), F.lit("\n"))
    return one.select("c_nationkey", "d", "n", whole.alias("text"))


def inspect_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every text sampled, answered by the heuristic and grounded."""
    rows = rendered_nations(spark, sf_dir).select("c_nationkey", F.col("text").cast("binary").alias("content"))
    out = inspection.inspect(spark, rows)
    r = F.col("result")
    return out.select(
        F.col("c_nationkey").cast("long").alias("nation"), r["delimiter"].alias("delimiter"), r["quotechar"].alias("quotechar"), r["has_header"].alias("has_header"), r["header_row_index"].cast("long").alias("header_row_index"),
        F.array_join(r["columns"], ",").alias("columns"), r["footer_rows_to_skip"].cast("long").alias("footer_rows_to_skip"), r["encoding"].alias("encoding"), F.col("error.class").alias("error"),
    )


def _answer(delimiter, header, index, footer, columns):
    """An answer struct of these parts."""
    return F.struct(
        F.lit("utf-8").alias("encoding"), delimiter.alias("delimiter"), F.lit('"').alias("quotechar"), F.lit(None).cast("string").alias("escapechar"), F.lit(True).alias("doublequote"), header.alias("has_header"),
        index.cast("int").alias("header_row_index"), footer.alias("footer_first_line"), columns.alias("columns"), F.lit(0.9).alias("confidence"),
    )


def ground_wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a wrong delimiter, header row and a paraphrased name, put right from the text."""
    rows = sampling.sample(sampling.windows_of(rendered_nations(spark, sf_dir).withColumn("content", F.col("text").cast("binary"))))
    wrong = F.when(F.col("d") == ",", ";").otherwise(",")
    rows = rows.withColumn("answer", _answer(wrong, F.lit(True), F.lit(0), F.concat(F.lit("TOTAL"), wrong, wrong, F.col("n").cast("string")), F.array(F.lit("custkey"), F.lit("customer name"), F.lit("balance"), F.lit("segment"))))
    out = grounding.ground(rows.drop("content", "text"))
    diff = F.transform(grounding.grounding_diff(out), lambda d: d["field"])
    return out.select(F.col("c_nationkey").cast("long").alias("nation"), F.col("result.delimiter").alias("delimiter"), F.col("result.header_row_index").cast("long").alias("header_row_index"), F.array_join("result.columns", ",").alias("columns"), F.array_join("result.footer_lines", "\n").alias("footer"), F.array_join(diff, ",").alias("changed"))


def headerless_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a header, answered as if the first row were one."""
    cells = [F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.col("c_mktsegment")]
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", fixtures.row(cells, ";").alias("line"))
    texts = rows.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))).alias("x"))
    texts = texts.select("c_nationkey", F.array_join(F.transform("x", lambda r: r["line"]), "\n").cast("binary").alias("content"))
    names = F.array(F.lit("id"), F.lit("who"), F.lit("amount"), F.lit("group"))
    out = grounding.ground(sampling.sample(sampling.windows_of(texts)).withColumn("answer", _answer(F.lit(";"), F.lit(True), F.lit(0), F.lit(None).cast("string"), names)).drop("content"))
    return out.select(F.col("c_nationkey").cast("long").alias("nation"), F.col("result.has_header").alias("has_header"), F.col("result.header_row_index").cast("long").alias("header_row_index"), F.array_join("result.columns", ",").alias("columns"))


def inspect_roundtrip_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every rendered text, read by what its inspection says."""
    rows = rendered_nations(spark, sf_dir).select("c_nationkey", F.col("text").cast("binary").alias("content"))
    results = inspection.inspect(spark, rows).select("c_nationkey", "result")

    def run(key, left, right):
        import pandas as pd

        out = []
        for content in left["content"]:
            found = {k: (v.tolist() if hasattr(v, "tolist") else v) for k, v in dict(right["result"].iloc[0]).items()}
            out += [(int(r[0]), r[1], r[2], r[3]) for r in reading.read_rows(bytes(content), found)]
        return pd.DataFrame(out, columns=["custkey", "name", "balance", "segment"])

    return rows.groupBy("c_nationkey").cogroup(results.groupBy("c_nationkey")).applyInPandas(run, "custkey long, name string, balance string, segment string")


# ---------------------------------------------------------------- evaluation


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the evaluation lines of a run: repeats of 60 fixtures."""
    i = F.col("event_id")
    bad = lambda f, n: F.when(i % n == 0, F.struct(F.lit(f).alias("field"), F.lit("x").alias("expected"), (i % 3).cast("string").alias("actual")))
    good = lambda f, n: F.when(i % n != 0, F.lit(f))
    parts = (("delimiter", 5), ("columns", 7), ("footer_lines", 2))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), (F.col("user_id") % 60).cast("string")).alias("fixture"), F.col("event_type").alias("category"), i.cast("int").alias("repeat"), (F.col("user_id") % 60 >= 55).alias("known_limitation"),
        F.array_compact(F.array(*(good(f, n) for f, n in parts))).alias("matched"), F.array_compact(F.array(*(bad(f, n) for f, n in parts))).alias("mismatched"), (F.size(F.array_compact(F.array(*(good(f, n) for f, n in parts)))) / 3).alias("score"),
        F.col("value").alias("latency_seconds"), F.when(F.col("event_type") == "error", F.concat(F.when(i % 2 == 0, "ModelTimeoutError: status ").otherwise("ModelInvocationError: status "), F.element_at(F.array(F.lit("429"), F.lit("503"), F.lit("500")), (i % 3 + 1).cast("int")))).alias("error"), F.col("ts"),
    )


def eval_scores_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.scores_by(run_lines(spark, sf_dir))
    return out.select(F.coalesce("category", F.lit("*")).alias("category"), F.coalesce("fixture", F.lit("*")).alias("fixture"), "n", F.round("score", 6).alias("score"))


def eval_field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.field_scores(run_lines(spark, sf_dir)).select("field", F.round("score", 6).alias("score"))


def eval_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.latencies(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "slowest")


def eval_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.field_stats(evaluation.votes(run_lines(spark, sf_dir)))
    return out.select("fixture", "field", "n_votes", "n_match", "majority", F.round("agreement", 6).alias("agreement"), "n_answers")


def eval_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_lines(spark, sf_dir)
    return evaluation.verdicts(rows, evaluation.field_stats(evaluation.votes(rows))).select("fixture", "verdict", "disagrees")


def eval_verdict_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_lines(spark, sf_dir)
    told = [evaluation.verdicts(half, evaluation.field_stats(evaluation.votes(half))) for half in (rows.where("hour(ts) < 12"), rows.where("hour(ts) >= 12"))]
    return reports.verdict_changes(*told)


def eval_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_lines(spark, sf_dir).where("error IS NOT NULL")
    return rows.groupBy(evaluation.error_class(F.col("error")).alias("class"), evaluation.transient_status(F.col("error")).alias("status")).agg(F.count("*").alias("n"))


def column_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ", -1)
    actual = F.filter(words, lambda x, i: i % 3 != 1)
    names = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("fixture"), words.alias("expected"), actual.alias("actual"))
    out = evaluation.column_recall(names)
    return out.select("fixture", F.round("columns_recall", 6).alias("columns_recall"), "columns_count_match")


def compare_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the flagship's results against the ground truth, by field."""
    texts = rendered_nations(spark, sf_dir)
    rows = texts.select(F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("fixture"), F.col("text").cast("binary").alias("content"))
    manifest = _manifest(texts)
    out = evaluation.comparisons(inspection.inspect(spark, rows).select("fixture", "result"), manifest)
    return out.groupBy("field", "verdict").agg(F.count("*").alias("n"))


def select_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("fixture"), F.col("lang").alias("category"))
    return guards.select_fixtures(manifest, categories=["de", "fr"], first=25)


def unknown_names_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.unknown(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def held_fixtures_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.held(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


def replay_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("model"), "text"))).alias("x"))
    lines = rows.select(F.col("conv_id").alias("fixture"), F.lit(0).alias("repeat"), F.transform("x", lambda r: F.struct(r["model"], r["text"])).alias("raw_response"))
    return guards.replay_answers(lines).select(F.col("fixture").alias("conv_id"), "model", F.col("k").cast("long").alias("k"), F.md5("text").alias("text_md5"))


def metrics_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs side by side: one for each type of event, with the counts and latencies of its events."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"))
    summaries = {r["event_type"]: {"lines": r["n"], "fixtures_run": r["users"], "latency_seconds": {"p50": r["p50"], "p95": r["p95"]}, "category_scores": {r["event_type"]: r["n"] / 1e6}} for r in rows.orderBy("event_type").collect()}
    return reports.table(spark, summaries)


def repeat_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority and agreement of each field over the regular fixtures, from repeat_stats()."""
    told = evaluation.repeat_stats(run_lines(spark, sf_dir))
    return spark.createDataFrame([(f, round(m, 6), round(told["field_agreement"][f], 6)) for f, m in told["field_majority_scores"].items()], "field string, majority double, agreement double")


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_lines(spark, sf_dir)
    return rows.select("repeat", F.round(evaluation.line_score(F.col("matched"), F.col("mismatched"), F.col("error")), 6).alias("score"))


def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as request ids: which are taken as they are."""
    header = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("id "), F.col("event_id").cast("string"))).when(F.col("event_id") % 4 == 1, F.repeat(F.col("event_type"), F.col("event_id").cast("int") % 40)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", header.rlike(rf"\A{C.REQUEST_ID}\z").alias("taken"))


def escape_is_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose escape character is their quote, and answers with an anchor of several lines."""
    i = F.col("event_id")
    quote, escape = F.element_at(F.array(F.lit('"'), F.lit("'")), (i % 2 + 1).cast("int")), F.element_at(F.array(F.lit('"'), F.lit("'"), F.lit("~")), (i % 3 + 1).cast("int"))
    anchor = F.when(i % 5 == 0, F.concat(F.lit("\\n  \\r\\n"), "event_type", F.lit("\\nmore"))).otherwise(F.col("event_type"))
    raw = F.concat(
        F.lit('{"encoding": "utf-8", "delimiter": ",", "quotechar": '), F.to_json(F.struct(quote.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(quote.alias("v")))) - 6), F.lit(', "escapechar": '), F.to_json(F.struct(escape.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(escape.alias("v")))) - 6),
        F.lit(', "doublequote": false, "has_header": false, "header_row_index": null, "footer_first_line": "'), anchor, F.lit('", "columns": ["a"], "confidence": 0.5}'),
    )
    rows = table(spark, sf_dir, "events").select("event_id", answers.parsed(raw).alias("p"))
    return rows.select("event_id", F.col("p.answer.escapechar").alias("escapechar"), F.col("p.answer.doublequote").alias("doublequote"), F.col("p.answer.footer_first_line").alias("footer_first_line"), F.col("p.error.class").alias("error"))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts hold the sampled lines between their marks, whole."""
    rows = sampling.sample(sampling.windows_of(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))))
    p = prompts.prompt(F.col("head_text"), F.col("tail_text"), F.col("covers_whole_file"), F.col("encoding"))
    return rows.select("doc_id", (F.contains(p, F.col("head_text")) & F.coalesce(F.contains(p, F.col("tail_text")), F.lit(True))).alias("has_sample"), F.col("tail_text").isNotNull().alias("has_tail"))


def _manifest(texts: DataFrame) -> DataFrame:
    """Ground truth of rendered_nations()."""
    truth = F.struct(
        F.lit("utf-8 or ascii (no mark)").alias("encoding"), F.col("d").alias("delimiter"), F.lit('"').alias("quotechar"), F.lit(None).cast("string").alias("escapechar"), F.lit(None).cast("boolean").alias("doublequote"), F.lit(True).alias("has_header"), F.lit(2).alias("header_row_index"),
        F.array(F.lit(""), F.concat(F.lit("TOTAL"), "d", "d", F.col("n").cast("string"), F.col("d"))).alias("footer_lines"), F.lit(2).alias("footer_rows_to_skip"), F.array(F.lit("custkey"), F.lit("name"), F.lit("balance"), F.lit("segment")).alias("columns"),
    ).cast(runner.EXPECTED)
    return texts.select(F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("fixture"), F.lit("nations").alias("category"), F.lit(False).alias("known_limitation"), truth.alias("expected"), F.array(*(F.lit(f) for f in C.RESULT_FIELDS)).alias("present"), F.lit(None).cast("string").alias("expected_error"))


def _nation_run(spark: SparkSession, sf_dir: str, **options) -> tuple[str, DataFrame, DataFrame]:
    """A run over rendered_nations() in a folder of its own: the folder, the windows and the manifest."""
    texts = rendered_nations(spark, sf_dir)
    windows = sampling.windows_of(texts.select(F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("fixture"), F.col("text").cast("binary").alias("content"))).drop("content")
    manifest, path = _manifest(texts), runs.scratch(spark, "run")
    runner.run(windows, manifest, path, **options)
    return path, windows, manifest


def run_loop_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two repeats with a budget of 31 calls, one a file: the first 31 files in order."""
    path, _, _ = _nation_run(spark, sf_dir, repeats=2, max_calls=31)
    return runs.read(spark, path)["evaluations"].select("fixture", "repeat", F.col("calls").cast("long").alias("calls"), F.round("score", 6).alias("score"), "error")


def replay_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of a run that its budget stopped, replayed: as many files, the same scores, the rest skipped."""
    path, windows, manifest = _nation_run(spark, sf_dir, max_calls=17)
    summary = runner.replay(windows, manifest, path, f"{path}-replay")
    return spark.createDataFrame([(summary["fixtures_run"], summary["replay_skipped"], summary["replay_of"] == path, round(summary["aggregate_score"], 6))], "fixtures long, skipped long, named boolean, score double")


def summarize_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run without its summary line, recovered."""
    path = runs.scratch(spark, "interrupted")
    lines = run_lines(spark, sf_dir).select("*", F.lit(None).cast(runs.USAGE).alias("usage"), F.lit(1).alias("calls"), F.lit(None).cast("double").alias("columns_recall"), F.lit(None).cast("boolean").alias("columns_count_match"), F.expr("CAST(map() AS map<string,string>)").alias("attempt_errors")).drop("ts")
    spark.createDataFrame([('{"run": {"model": "m", "fixtures_planned": 60}}',)], "value string").coalesce(1).write.text(path)
    runs.append(lines, path)
    s = runner.summarize_interrupted(spark, path)
    return spark.createDataFrame([(s["incomplete"], s["stopped_early"], s["fixtures_planned"], s["fixtures_run"], s["lines"], s["errored_lines"], s["scored_lines"], round(s["aggregate_score"], 6))], "incomplete boolean, stopped_early string, planned long, fixtures long, lines long, errored long, scored long, score double")


def tail_redetect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ASCII head of a full window before each text in Latin-1: the tail tells the codec."""
    latin = F.encode(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(b"x,y\n" * 1024), latin).alias("content"))
    return sampling.sample(sampling.windows_of(rows)).select("doc_id", "encoding")


def quote_escaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages' quotes make of an answer with the escape character ~."""
    e = grounding.escaping(text.quote_evidence(F.col("html"), F.lit(" "), F.lit('"')), F.lit("~"), F.lit(False))
    return table(spark, sf_dir, "pages").select("page_id", e.alias("e")).select("page_id", "e.*")


def one_column_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with two names over texts that no delimiter splits: the header is the line that is the first name."""
    lines = F.slice(text.lines(F.col("text")), 1, 10)
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    name = F.coalesce(text.strip(F.get("l", (F.col("doc_id") % 5).cast("int"))), F.lit("nowhere"))
    h = grounding.header(F.array(name, F.lit("other")), F.col("doc_id") % 2 == 0, (F.col("doc_id") % 7).cast("int"), F.col("l"), F.transform("l", lambda x: F.array(x)), F.lit(0))
    return rows.select("doc_id", h.alias("h")).select("doc_id", "h.has_header", F.col("h.header_row_index").cast("long").alias("header_row_index"), F.get("h.columns", F.lit(0)).alias("name"))


# ---------------------------------------------------------------- streaming


def stream_rolling_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks, streamed, and folded to windows again."""
    from tabscout.streaming import rolling

    path = runs.scratch(spark, "chunks")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stream"), F.encode("text", "UTF-8").alias("b"))
    n = F.ceil(F.octet_length("b") / 1000).cast("int")
    chunks = docs.select("stream", F.explode(F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.cast("long").alias("seq"), F.substring(F.col("b"), k * 1000 + 1, F.lit(1000)).alias("chunk"), (k == n).alias("eof")))).alias("c")).select("stream", "c.*")
    chunks.write.parquet(f"{path}/in")
    stream = rolling.rolling_windows(spark.readStream.schema("stream string, seq long, chunk binary, eof boolean").parquet(f"{path}/in"), head_bytes=512, tail_bytes=256)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(rolling.OUTPUT).parquet(f"{path}/out")
    return out.select(F.col("stream").cast("long").alias("doc_id"), "size", F.md5("head").alias("head_md5"), F.md5("tail").alias("tail_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        inspect_rendered, ground_wrong_answers, headerless_detect, inspect_roundtrip_read, compare_results, line_count, line_bounds, trim_to_last_break, byte_windows, encoding_canonical, tail_alignment, utf8_suffix,
        delimiter_scores, delimiter_choice, split_fields_rfc4180, delimited_lines, field_shapes, rows_look_alike, positional_names, totals_labels, quote_evidence, json_payload, dialect_slips, answer_rule_violations,
        answers_parsed, prompt_sizes, dry_run_total, usage_tally, call_budget_prefix, rate_window, eval_scores_by, eval_field_scores, eval_percentiles, eval_votes, eval_verdicts, eval_verdict_changes, eval_error_classes,
        column_recall, select_fixtures, unknown_names_anti, held_fixtures_semi, replay_join, metrics_pivot, stream_rolling_tail, repeat_statistics, line_scores, request_ids, escape_is_quote, prompt_texts, run_loop_budget, replay_run, summarize_interrupted, tail_redetect, quote_escaping, one_column_header,
    )
}
