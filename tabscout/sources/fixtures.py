"""Rows rendered to delimited text with known quirks: the ground truth of tests and queries, all in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Footers: none, a totals row, an end marker, a time stamp, a blank line and totals.
FOOTERS = ("none", "totals", "marker", "timestamp", "blank_totals")


@dataclass(frozen=True)
class Spec:
    """How rows become a text."""

    delimiter: str = ","
    quote: str = '"'
    newline: str = "\n"
    preamble: tuple[str, ...] = ()
    header: bool = True
    footer: str = "none"
    quote_header: bool = False
    bom: bool = False

    def __post_init__(self) -> None:
        if self.footer not in FOOTERS:
            raise ValueError(f"footer must be one of {', '.join(FOOTERS)}")
        if self.preamble and not self.header:
            raise ValueError("a preamble needs a header")

    def footer_lines(self, width: int) -> list[str]:
        totals = "TOTAL" + self.delimiter * (width - 1) + "1"
        return {"none": [], "totals": [totals], "marker": ["", "--- end of report ---", "Generated 2024-08-01 10:00:00"], "timestamp": ["Generated 2024-08-01 10:00:00"], "blank_totals": ["", totals]}[self.footer]


def field(value: Column, delimiter: Column | str, quote: str = '"') -> Column:
    """A field as RFC 4180 writes it: quoted if it has the delimiter, a quote or a line break; null is empty."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    needs = F.contains(v, delimiter if isinstance(delimiter, Column) else F.lit(delimiter)) | F.contains(v, F.lit(quote)) | v.rlike(r"[\r\n]")
    return F.when(needs, F.concat(F.lit(quote), F.replace(v, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(v)


def row(columns: list[Column], delimiter: Column | str, quote: str = '"') -> Column:
    """One line."""
    d = delimiter if isinstance(delimiter, Column) else F.lit(delimiter)
    cells = [c for k, v in enumerate(columns) for c in ([d] if k else []) + [field(v, d, quote)]]
    return F.concat(*cells)


def render(df: DataFrame, group: str, order: str, columns: list[str], spec: Spec) -> DataFrame:
    """Rows (group, text): the rows of each group as one text, in order. A group is a file, so it fits in a row."""
    names = [f"{spec.quote}{c}{spec.quote}" if spec.quote_header else c for c in columns]
    head = [*spec.preamble, *([spec.delimiter.join(names)] if spec.header else [])]
    tail = spec.footer_lines(len(columns))
    lines = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row([F.col(c) for c in columns], spec.delimiter, spec.quote).alias("line")))).alias("x"))
    every = F.concat(F.array(*(F.lit(x) for x in head)).cast("array<string>"), F.transform("x", lambda x: x["line"]), F.array(*(F.lit(x) for x in tail)).cast("array<string>"))
    return lines.select(group, F.concat(F.lit("﻿" if spec.bom else ""), F.array_join(every, spec.newline), F.lit(spec.newline)).alias("text"))


def manifest(specs: dict[str, Spec], columns: list[str]) -> list[dict]:
    """Ground truth of files rendered by each spec, one entry a file."""
    return [
        {"filename": name, "expected": {"delimiter": s.delimiter, "quotechar": s.quote, "has_header": s.header, "header_row_index": len(s.preamble) if s.header else None, "footer_lines": s.footer_lines(len(columns)), "footer_rows_to_skip": len(s.footer_lines(len(columns))), "columns": list(columns) if s.header else [f"column_{k + 1}" for k in range(len(columns))]}}
        for name, s in sorted(specs.items())
    ]
