"""Text functions as Column expressions: lines, stripping, shapes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabscout import constants as C

#: White space as Python's str.strip() takes it: Unicode's and the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def lines(text: Column, keep_ends: bool = False) -> Column:
    """Lines that end with CRLF, CR or LF only; a final break begins no line. Null: none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"), F.lit(0))
    return found if keep_ends else F.transform(found, lambda x: F.regexp_replace(x, r"[\r\n]+\z", ""))


def line_count(text: Column) -> Column:
    return F.size(lines(text, keep_ends=True))


def trim_to_break(text: Column) -> Column:
    """Up to the last line break; a text without any stays."""
    return F.when(text.rlike(r"[\r\n]"), F.regexp_replace(text, r"(?<=[\r\n])[^\r\n]++\z", "")).otherwise(text)


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "\\A\ufeff+", "")


def last(items: Column, n: int) -> Column:
    """The last n items, or all of a shorter array."""
    return F.slice(items, F.greatest(F.size(items) - (n - 1), F.lit(1)), F.lit(n))


def joined(items: Column) -> Column:
    return F.array_join(items, "")


def field_shape(value: Column) -> Column:
    """empty, integer, date, decimal or text; digits are Unicode's, dates come before decimals."""
    v = strip(value)
    whole = lambda pattern: v.rlike(rf"(?U)\A(?:{pattern})\z")
    return F.when(v == "", "empty").when(whole(C.INTEGER), "integer").when(whole(C.DATE), "date").when(whole(C.DECIMAL), "decimal").otherwise("text")


def look_alike(first: Column, second: Column) -> Column:
    """Do two rows (arrays of fields, as long) have like shapes?

    The same shapes, or shapes that agree but for empty fields while at least half of each are not text.
    """
    a, b = F.transform(first, field_shape), F.transform(second, field_shape)
    agree = F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (x == "empty") | (y == "empty")), lambda ok: F.coalesce(ok, F.lit(False)))
    half = F.ceil(F.size(first) / 2)
    firm = lambda shapes: F.size(F.filter(shapes, lambda s: s != "text")) >= half
    return (a == b) | (agree & firm(a) & firm(b))


def folded(value: Column) -> Column:
    """Lower case for comparison; sharp s folds to ss."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def positional(n: Column) -> Column:
    """column_1 to column_n."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("column_"), i.cast("string")))).otherwise(F.expr("CAST(array() AS array<string>)"))


def modal_width(counts: Column) -> Column:
    """struct<agreeing,width> of the most common field count of 2 or more; ties: the first seen; none: (0, 1)."""
    wide = F.filter(counts, lambda n: n > 1)
    votes = F.transform(F.array_distinct(wide), lambda w, i: F.struct(F.size(F.filter(wide, lambda x: x == w)).alias("agreeing"), (-i).alias("first"), w.alias("width")))
    best = F.array_max(votes)
    return F.struct(F.coalesce(best["agreeing"], F.lit(0)).alias("agreeing"), F.coalesce(best["width"], F.lit(1)).alias("width"))


def squashed(text: Column) -> Column:
    """Runs of white space and usual separators as one blank, stripped."""
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f,;|]+", " "))


def anchors(key: Column, line: Column, delimiter: Column) -> Column:
    """Does a reported line designate this line of the file?"""
    ends = F.concat(delimiter, F.lit(" \t"))
    same = F.rtrim(key, ends) == F.rtrim(strip(line), ends)
    within = (F.length(key) >= C.MIN_SUBSTRING_ANCHOR) & F.contains(line, key)
    return same | (squashed(key) == squashed(line)) | within


def has_totals_label(line: Column) -> Column:
    """Does a stripped line begin with a totals label?"""
    return line.rlike(rf"""(?iU)\A["']?\s*{C.TOTALS_LABEL}\b""")


def is_totals_label(field: Column) -> Column:
    """Is a stripped field nothing but a totals label?"""
    return field.rlike(rf"(?iU)\A(?:{C.TOTALS_LABEL}(?:\s+general)?\s*:?)\z")


def extends_footer(line: Column, fields: Column) -> Column:
    """Is a line blank, or labelled totals? `fields` are those of the stripped line (null: unparsable).

    A label counts if the first field is nothing else, or at most half of the others are filled.
    """
    bare = strip(line)
    others = F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))
    filled = F.size(F.filter(others, lambda f: strip(f) != ""))
    totals = has_totals_label(bare) & (F.size(fields) > 0) & (is_totals_label(strip(F.get(fields, F.lit(0)))) | (filled * 2 <= F.size(others)))
    return (bare == "") | F.coalesce(totals, F.lit(False))


def quoted_literal(text: Column) -> Column:
    """A regular expression that matches a text literally."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def in_class(text: Column) -> Column:
    """Characters, each escaped for a character class."""
    return F.regexp_replace(text, r"([^A-Za-z0-9\s])", "\\\\$1")


def has_quoted_field(text: Column, delimiter: Column, quote: Column) -> Column:
    """Does a line hold a field between quotes, at field edges?"""
    d, q = quoted_literal(delimiter), quoted_literal(quote)
    pattern = F.concat(F.lit("(?m)(?:^|"), d, F.lit(")"), q, F.lit("[^"), in_class(quote), F.lit("\\r\\n]+"), q, F.lit("(?="), d, F.lit("|\\r|$)"))
    return F.regexp_like(text, pattern)


def quote_evidence(text: Column, delimiter: Column, quote: Column) -> Column:
    """struct<backslashed,doubled,quoted>: what the text shows of how quotes are escaped."""
    field = F.concat(F.lit("[^"), in_class(F.concat(delimiter, quote)), F.lit("\\\\\\r\\n]"), quoted_literal(F.concat(quote, quote)))
    return F.struct(F.contains(text, F.concat(F.lit("\\"), quote)).alias("backslashed"), F.regexp_like(text, field).alias("doubled"), has_quoted_field(text, delimiter, quote).alias("quoted"))
