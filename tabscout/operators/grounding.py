"""Grounding: what an answer says, recomputed from the sampled text. Array expressions on one row a file.

Only the splitting of lines into fields leaves the JVM, once (Arrow). ground() adds one step after another, so
that each intermediate value is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout import constants as C
from tabscout.functions import codecs, text
from tabscout.functions.fields import splits

_STRINGS = "array<string>"
#: What ground() returns of an answer.
RESULT = ("encoding", "delimiter", "quotechar", "escapechar", "doublequote", "has_header", "header_row_index", "columns", "footer_lines", "footer_rows_to_skip", "confidence")


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def delimiter(reported: Column, scores: Column, occurs: Column, taken: Column) -> Column:
    """The delimiter to believe.

    scores: array<struct<delimiter,agreeing>>, the reported one first. `taken` are the quote and escape
    characters, which no other candidate may be. One candidate alone that scores best, at least
    MIN_AGREEING_LINES and DOMINANCE_RATIO times the reported one's score, replaces it; a reported one that
    never occurs becomes a comma, if that is free.
    """
    own = F.when(occurs, F.get(scores, F.lit(0))["agreeing"]).otherwise(F.lit(0))
    rivals = F.filter(scores, lambda s, i: (i > 0) & ~F.array_contains(F.array_append(taken, reported), s["delimiter"]))
    best = F.coalesce(F.array_max(F.transform(rivals, lambda s: s["agreeing"])), F.lit(0))
    winners = F.filter(rivals, lambda s: s["agreeing"] == best)
    clear = (best >= F.greatest(F.lit(float(C.MIN_AGREEING_LINES)), own * C.DOMINANCE_RATIO)) & (F.size(winners) == 1)
    free = ~F.array_contains(F.array_append(taken, reported), ",")
    return F.when(clear, F.get(winners, F.lit(0))["delimiter"]).when(~occurs & free, ",").otherwise(reported)


def escaping(evidence: Column, escapechar: Column, doublequote: Column) -> Column:
    """struct<escapechar,doublequote> from quote_evidence(): one way alone decides, none with a quoted field means no escape."""
    pair = lambda e, d: F.struct(e.alias("escapechar"), d.alias("doublequote"))
    back, twice = evidence["backslashed"], evidence["doubled"]
    return (
        F.when(back & ~twice, pair(F.lit("\\"), F.lit(False)))
        .when(twice & ~back, pair(_none("string"), F.lit(True)))
        .when(~back & ~twice & evidence["quoted"], pair(_none("string"), doublequote))
        .otherwise(pair(escapechar, doublequote))
    )


def _stripped(fields: Column) -> Column:
    return F.transform(fields, text.strip)


def header_row(names: Column, rows: Column) -> Column:
    """struct<at,fields> of the header line: its fields are the names (blank ones aside if it is wider);
    else it has as many, the next line too, and it shares a name. Null: neither."""
    wanted = _stripped(names)
    n = F.size(wanted)
    places = F.sequence(F.lit(0), F.size(rows) - 1)
    row = lambda i: F.get(rows, i)

    def exact(i: Column) -> Column:
        own = _stripped(row(i))
        return row(i).isNotNull() & ((own == wanted) | ((F.size(own) > n) & (F.filter(own, lambda f: f != "") == wanted)))

    named = F.filter(wanted, lambda f: f != "")

    def shares(i: Column) -> Column:
        return row(i).isNotNull() & row(i + 1).isNotNull() & (F.size(row(i)) == n) & (F.size(row(i + 1)) == n) & F.arrays_overlap(_stripped(row(i)), named)

    first = F.get(F.filter(places, lambda i: F.coalesce(exact(i), F.lit(False))), F.lit(0))
    at = F.coalesce(first, F.get(F.filter(places, lambda i: F.coalesce(shares(i), F.lit(False))), F.lit(0)))
    return F.when((F.size(rows) > 0) & (n > 0) & at.isNotNull(), F.struct(at.alias("at"), F.get(rows, at).alias("fields")))


def first_row_is_data(names: Column, rows: Column) -> Column:
    """Do the first two lines have a field for each name and like shapes, and the first none of the names?"""
    first, second = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    n = F.size(names)
    wide = first.isNotNull() & second.isNotNull() & (F.size(first) > 0) & (F.size(first) == n) & (F.size(second) == n)
    known = F.filter(F.transform(names, lambda c: text.folded(text.strip(c))), lambda c: c != "")
    shared = F.exists(first, lambda f: F.array_contains(known, text.folded(text.strip(f))))
    return F.coalesce((F.size(rows) >= C.MIN_AGREEING_LINES) & wide & ~shared & text.look_alike(first, second), F.lit(False))


def header(names: Column, has_header: Column, index: Column, lines: Column, rows: Column, agreeing: Column) -> Column:
    """struct<has_header,header_row_index,columns> by the first rule that applies: one column, no header, header."""
    out = lambda h, i, c: F.struct(h.alias("has_header"), i.cast("int").alias("header_row_index"), c.cast(_STRINGS).alias("columns"))
    no, yes = F.lit(False), F.lit(True)
    # several names, but no line that splits: one column
    place = F.array_position(F.transform(lines, text.strip), F.get(names, F.lit(0)))
    at = F.when(place > 0, place.cast("int") - 1).when(has_header, index)
    row = F.get(rows, at)
    alone = F.when(at.isNull() | (at >= F.size(rows)), out(no, _none("int"), F.array(F.lit("column_1")))).otherwise(out(yes, at, F.array(F.coalesce(F.get(row, F.lit(0)), F.lit("")))))
    # no header: unless a line has just these names and the next one is not of its kind
    places = F.sequence(F.lit(0), F.size(rows) - 1)

    def heads(i: Column) -> Column:
        own, after = F.get(rows, i), F.get(rows, i + 1)
        other = after.isNull() | ((F.size(after) == F.size(own)) & ~text.look_alike(own, after))
        return F.coalesce(own.isNotNull() & (_stripped(own) == names) & other, no)

    found = F.when(F.size(rows) > 0, F.get(F.filter(places, heads), F.lit(0)))
    absent = F.when(found.isNotNull(), out(yes, found, F.get(rows, found))).otherwise(out(no, index, text.positional(F.size(names))))
    # a header: where its line is; not anchored at line 0 over data: none
    line = header_row(names, rows)
    present = F.when(line.isNotNull(), out(yes, line["at"], line["fields"])).when((index == 0) & first_row_is_data(names, rows), out(no, _none("int"), text.positional(F.size(names)))).otherwise(out(has_header, index, names))
    return F.when((F.size(names) > 1) & (agreeing == 0), alone).when(~has_header, absent).otherwise(present)


def data_width(lines: Column, rows: Column) -> Column:
    """The most common field count of the lines after the first, if half of those that are not blank have it; else null."""
    after = F.filter(F.arrays_zip(lines.alias("line"), rows.alias("fields")), lambda x, i: (i > 0) & (text.strip(x["line"]) != ""))
    modal = text.modal_width(F.transform(after, lambda x: F.when(x["fields"].isNotNull(), F.size(x["fields"]))))
    return F.when((modal["agreeing"] > 0) & (modal["agreeing"] * 2 >= F.size(after)), modal["width"])


def is_data_row(fields: Column, extends: Column, width: Column) -> Column:
    """Has a line that width, half of it filled, and no totals label?"""
    filled = F.size(F.filter(fields, lambda f: text.strip(f) != ""))
    return F.coalesce(fields.isNotNull() & (F.size(fields) == width) & (filled * 2 >= width) & ~extends, F.lit(False))


def footer_start(n: Column, width: Column, data: Column, extends: Column, found: Column) -> Column:
    """The first footer line (n: none): after the last data row; without a width, from the anchor up over blank and totals lines."""
    last = F.array_max(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i > 0) & F.get(data, i)))
    start = F.coalesce(found, n)
    stop = F.array_max(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i > 0) & (i < start) & ~F.get(extends, i)))
    return F.when(width.isNotNull(), F.coalesce(last, F.lit(0)) + 1).when(start <= 1, start).otherwise(F.coalesce(stop + 1, F.lit(1)))


def encoding(reported: Column, detected: Column) -> Column:
    """The reported encoding, unless it is no codec or misses a byte order mark that was detected."""
    r, d = codecs.canonical(reported), codecs.canonical(detected)
    misses = d.isin(*C.BOM_CODECS) & ~r.eqNullSafe(d)
    return F.when(detected.isNull(), reported).when(misses | r.isNull(), detected).otherwise(reported)


def ground(df: DataFrame) -> DataFrame:
    """`df` with `result` (struct of RESULT) and `diagnostics` (array<string>).

    `df` has `answer` (struct of constants.ANSWER_FIELDS), head_text, tail_text, covers_whole_file and
    encoding (the detected one). A null answer gives a null result.
    """
    own = df.columns
    a = F.col("answer")
    rows = df.withColumn("__head", text.lines(text.without_bom(F.col("head_text")))).withColumn("__text", F.concat("head_text", F.coalesce("tail_text", F.lit(""))))
    candidates = F.concat(F.array(a["delimiter"]), F.array(*(F.lit(d) for d in C.CANDIDATE_DELIMITERS)))
    ended = F.when(F.col("tail_text").isNotNull(), text.lines(F.col("tail_text"))).when(F.col("covers_whole_file"), F.col("__head"))
    reported = text.strip(a["footer_first_line"])
    quote = F.when((a["quotechar"] != '"') & ~F.contains(F.col("__text"), a["quotechar"]), '"').otherwise(a["quotechar"])
    rows = rows.withColumns({"__tried": F.when(a.isNotNull(), F.array_distinct(candidates)), "__end": ended, "__q": quote, "__reported": reported})
    keys = lambda d: F.when(a["delimiter"] != d, F.array(F.col("__reported"), F.replace(F.col("__reported"), a["delimiter"], d))).otherwise(F.array(F.col("__reported")))
    every = F.transform("__tried", lambda d: F.when(F.col("__reported").isNotNull(), F.array_distinct(keys(d))))
    rows = rows.withColumns({"__end_bare": F.transform("__end", text.strip), "__keys_by": every})
    bare_keys = F.transform("__keys_by", lambda k: F.transform(k, text.strip))
    rows = rows.withColumn("__splits", splits(F.col("__head"), F.col("__end"), F.col("__end_bare"), F.col("__keys_by"), bare_keys, F.col("__tried"), a["quotechar"], F.col("__q")))
    scores = F.zip_with("__tried", "__splits", lambda d, s: F.struct(d.alias("delimiter"), text.modal_width(s["counts"])["agreeing"].alias("agreeing")))
    taken = F.array_compact(F.array(a["quotechar"], a["escapechar"]))
    rows = rows.withColumn("__scores", scores)
    rows = rows.withColumn("__d", delimiter(a["delimiter"], F.col("__scores"), F.contains(F.col("head_text"), a["delimiter"]), taken))
    chosen = F.get("__splits", (F.array_position("__tried", F.col("__d")) - 1).cast("int"))
    rows = rows.withColumns({"__chosen": chosen, "__keys": F.get("__keys_by", (F.array_position("__tried", F.col("__d")) - 1).cast("int"))})
    several = F.concat(F.coalesce("__end", F.expr("CAST(array() AS array<string>)")), F.coalesce("__keys", F.expr("CAST(array() AS array<string>)")))
    rows = rows.withColumns({"__all": several, "__rows": F.col("__chosen.rows"), "__fields": F.col("__chosen.fields"), "__bare": F.col("__chosen.bare")})
    reported = F.col("__reported")
    rows = rows.withColumn("__extends", F.zip_with("__all", "__bare", text.extends_footer))
    n = F.size("__end")
    rows = rows.withColumn("__width", data_width(F.col("__end"), F.slice("__fields", F.lit(1), F.greatest(n, F.lit(0)))))
    rows = rows.withColumn("__data", F.zip_with("__fields", "__extends", lambda f, e: is_data_row(f, e, F.col("__width"))))
    hit = lambda line: F.exists("__keys", lambda k: text.anchors(k, line, F.col("__d")))
    found = F.array_max(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i > 0) & hit(F.get("__end", i))))
    rows = rows.withColumn("__found", F.when((n > 0) & F.col("__keys").isNotNull(), found))
    miscopied = F.exists(F.slice("__data", n + 1, F.size("__keys")), lambda x: x)
    believed = (reported == "") | F.col("__found").isNotNull() | F.coalesce(F.col("__width").isNotNull() & miscopied, F.lit(False))
    start = footer_start(n, F.col("__width"), F.col("__data"), F.col("__extends"), F.col("__found"))
    rows = rows.withColumn("__start", F.when((n > 0) & believed, start))
    located = F.col("__start").isNotNull() & (F.col("__start") < n)
    none = F.expr("CAST(array() AS array<string>)")
    rows = rows.withColumn("__footer", F.when(located, F.slice("__end", F.col("__start") + 1, n - F.col("__start"))).otherwise(none))
    rows = rows.withColumn("__escape", escaping(text.quote_evidence(F.col("__text"), F.col("__d"), F.col("__q")), a["escapechar"], a["doublequote"]))
    agreeing = text.modal_width(F.transform("__rows", lambda f: F.when(f.isNotNull(), F.size(f))))["agreeing"]
    rows = rows.withColumn("__header", header(a["columns"], a["has_header"], a["header_row_index"], F.col("__head"), F.col("__rows"), agreeing))
    h, e = F.col("__header"), F.col("__escape")
    result = F.struct(
        encoding(a["encoding"], F.col("encoding")).alias("encoding"), F.col("__d").alias("delimiter"), F.col("__q").alias("quotechar"), e["escapechar"].alias("escapechar"), e["doublequote"].alias("doublequote"),
        h["has_header"].alias("has_header"), h["header_row_index"].alias("header_row_index"), h["columns"].alias("columns"), F.col("__footer").alias("footer_lines"), F.size("__footer").alias("footer_rows_to_skip"), a["confidence"].alias("confidence"),
    )
    dropped = a["footer_first_line"].isNotNull() & F.col("__end").isNotNull() & ~located
    notes = F.array_compact(F.array(F.when(dropped, "footer not found at the end of the file"), F.when(F.col("__d") != a["delimiter"], "delimiter replaced")))
    return rows.withColumn("result", F.when(a.isNotNull(), result)).withColumn("diagnostics", F.coalesce(notes, none)).select(*own, "result", "diagnostics")


def grounding_diff(df: DataFrame) -> Column:
    """array<struct<field,answered,grounded>> of the fields in which `answer` and `result` differ."""
    fields = [f for f in RESULT if f not in ("footer_lines", "footer_rows_to_skip")]
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f"answer.{f}"))).alias("answered"), F.to_json(F.struct(F.col(f"result.{f}"))).alias("grounded")) for f in fields))
    return F.filter(pairs, lambda p: ~p["answered"].eqNullSafe(p["grounded"]))
