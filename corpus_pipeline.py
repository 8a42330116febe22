"""The corpus pipeline: toxicity, SimHash near-dedup, benchmark decontamination, PII, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last
return the columns of `documents`. Stages are written as Parquet in the shared folder and read again.

- toxicity: learned from `labels`; documents whose score reaches the threshold go.
- near_duplicates: of each SimHash component the document with the smallest doc_id stays.
- decontamination: hit spans are cut; documents of which most words are hit go.
- pii: every span is replaced by its kind in brackets.
- mixing: words taken of each document for the target weights; documents of which none are taken go.

n_chars is that of the text that a stage returns.

All stages take the columns of `documents` by name and leave others out, whatever they are called. Repeated rows are
worked on one by one, ties go by doc_id, an empty table gives an empty one, and long texts are taken whole. Null and
empty texts and null ids: see each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.llm import decontamination, mixing, pii, quality_classifier, simhash_dedup, toxicity
from tabscout.llm.shared import shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of `documents`, n_chars counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have the score of texts like no example; rows of one id go together, those without an id too."""
    held_out = F.pmod(quality_classifier.crc(), F.lit(4)) == 2
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are alike, and one of them stays. Rows without an id stay; rows of one id stay or go together."""
    return simhash_dedup.deduplicate(docs).select(*COLUMNS)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no hits and stay; ids are only passed on."""
    return _documents(decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null, empty ones empty; ids are only passed on."""
    return _documents(pii.redact(docs.select(*COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken). Null and empty texts have no words and go; a null source is a source, a null id an id."""
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmarks),
    ("pii", redact_pii),
    ("mixing", mix_sources),
]

#: SimHash components and nearest neighbours are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
