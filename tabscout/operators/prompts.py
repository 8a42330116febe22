"""Prompts and the sizes that go with them, as Column expressions. The wording is this package's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabscout import constants as C
from tabscout.functions import text
from tabscout.functions.fields import field_counts

PROMPT_VERSION = "1"
_RULES = """Answer with one JSON object: encoding, delimiter, quotechar, escapechar, doublequote, has_header, header_row_index (lines before the line of column names, null without one), footer_first_line (the first line after the last record, copied as it is, or null), columns (names copied as they are; column_1, column_2, ... without a header), confidence (0 to 1)."""


def prompt(head: Column, tail: Column, covers: Column, encoding: Column) -> Column:
    """The prompt of a sample: with a tail, cut before the end, or of a whole file."""
    end = (
        F.when(tail.isNotNull(), F.concat(F.lit("\n[end of the file; its first line may be cut]\n"), tail, F.lit("\n[end]\nThe start stops inside the data. Look for footer lines in the last part only.\n")))
        .when(~covers, F.lit("\nOnly the start of the file was read: footer_first_line must be null.\n"))
        .otherwise(F.lit("\nThis is the whole file: its last lines are its end.\n"))
    )
    return F.concat(F.lit("A delimited text file, read as "), encoding, F.lit(":\n[start of the file]\n"), head, F.lit("\n[end of the start]"), end, F.lit(_RULES))


def head_field_count(head: Column) -> Column:
    """Fields of the usual delimiter that most lines agree on; ties: the wider."""
    tried = F.array(*(F.lit(d) for d in C.CANDIDATE_DELIMITERS))
    counts = field_counts(text.lines(text.without_bom(head)), tried, F.lit('"'))
    return F.array_max(F.transform(counts, text.modal_width))["width"]


def reply_tokens(fields: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(C.REPLY_FLOOR), F.lit(C.REPLY_BASE) + F.lit(C.REPLY_PER_FIELD) * fields), F.lit(C.REPLY_FLOOR))


def context_size(chars: Column, reply: Column) -> Column:
    """The first step that prompt and reply fit in; the last one if none."""
    need = F.ceil(chars / C.CHARS_PER_TOKEN) + reply
    steps = F.array(*(F.lit(s) for s in C.CONTEXT_STEPS))
    return F.coalesce(F.get(F.filter(steps, lambda s: s >= need), F.lit(0)), F.lit(C.CONTEXT_STEPS[-1]))


def estimated_tokens(chars: Column) -> Column:
    return F.rint(chars / C.CHARS_PER_TOKEN).cast("long")


def redacted(message: Column, secret: str | None) -> Column:
    return F.replace(message, F.lit(secret), F.lit("***")) if secret else message
