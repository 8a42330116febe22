"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each whole text are standardised and mapped to random cosines that approximate a
Gaussian kernel. Each partition of the labelled rows sums its part of the normal equations, Spark adds
the parts row by row of the matrix, and the driver solves one system of fixed size. The equations are
kept apart by fold, so each labelled row also has a score from a model that has not seen it: those are
binned in Spark and give the calibration.

What comes to the driver has a fixed size: means, (D + 1) rows for each fold, and the score bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.llm.calibration import Isotonic
from tabscout.llm.shared import written
from tabscout.llm.statistics import counted

#: Random features, kernel width in standard deviations, ridge weight for each labelled row, folds, score bins.
FEATURES, WIDTH, RIDGE, FOLDS, BINS = 192, 3.0, 1e-3, 4, 512
SEED = 20_240
STATISTICS = ("log_words", "word_length", "symbols", "digits", "upper", "punctuation", "stops", "duplicate_lines", "repeated_words", "distinct_words", "words_a_line", "solid", "log_chars")


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    rows = []
    for _, _, c in counted(column):
        words, chars, lines = np.maximum(c.n_words, 1), np.maximum(c.n_chars, 1), np.maximum(c.n_lines, 1)
        rows.append(np.stack([
            np.log1p(c.n_words), np.minimum(c.word_chars / words, 50), c.n_symbols / chars, c.counts_of("digits") / chars, c.counts_of("upper") / chars,
            c.counts_of("punctuation") / words, c.counts_of("stops") / words, c.n_dup_lines / lines, c.n_repeat_words / words, c.distinct_words() / words,
            np.log1p(c.n_words / lines), c.word_chars / chars, np.log1p(c.n_chars),
        ], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = text_statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["doc_id", *STATISTICS])


class _Map:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.direction = rng.standard_normal((len(mean), FEATURES)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in STATISTICS], axis=1)
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.direction + self.phase), np.ones((len(z), 1))])


def _summer(features: _Map):
    """Each partition's sums of x x' and x y, by fold and row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + 1
        total, seen = np.zeros((FOLDS, d, d + 1)), False
        for batch in batches:
            x, y, fold = features(batch), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            seen = seen or len(x) > 0
            for k in range(FOLDS):
                own = fold == k
                total[k] += x[own].T @ np.hstack([x[own], y[own, None]])
        if seen:
            rows = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), d + 1).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(FOLDS), d), pa.int32()), pa.array(np.tile(np.arange(d), FOLDS), pa.int32()), rows], names=["fold", "row", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    """One row of the equations: the sum of all partitions'."""
    flat = table.column("sums").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
    return pa.table([table.column("fold").slice(0, 1), table.column("row").slice(0, 1), pa.array([flat], pa.list_(pa.float64()))], names=["fold", "row", "sums"])


def _solved(sums: np.ndarray) -> np.ndarray:
    """Ridge weights of the summed equations; the constant is not penalised."""
    n = sums[-1, -2]
    penalty = np.full(len(sums), max(n, 1) * RIDGE)
    penalty[-1] = 1e-9
    return np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1])


def _scorer(features: _Map, weights: np.ndarray, calibrated: Isotonic | None):
    """Rows (doc_id, fold, label, raw) with the fold's own weights; or (doc_id, score) with the last weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch)
            if calibrated:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(calibrated(x @ weights[-1]))], names=["doc_id", "score"])
            else:
                raw = np.einsum("ij,ij->i", x, weights[batch.column("fold").to_numpy()])
                yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("label")], names=["raw", "label"])

    return run


def training_labels(labels: DataFrame, label_column: str, learn: Column) -> DataFrame:
    """Rows (doc_id, label double): one for each labelled id that may be learned from; of several labels the mean decides, a tie is 1."""
    own = labels.where(learn & F.col(label_column).isNotNull() & F.col("doc_id").isNotNull())
    return own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(label_column)) >= 0.5).cast("double").alias("label"))


def crc(id_column: str = "doc_id") -> Column:
    """CRC-32 of an id as text."""
    return F.crc32(F.col(id_column).cast("string").cast("binary"))


def scores(docs: DataFrame, labels: DataFrame, learn: Column, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, score double from 0 to 1), one for each row of `docs`.

    learn: a condition on `labels`, true for rows that labels may be learned from. Only texts are inputs
    of a score. Empty and null texts are scored like any other; null ids have a score and no label. With
    no labels at all the score is 0.5; an empty table gives no rows. Repeated rows each give a row, and
    each counts as a labelled example. Other columns of `docs` are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    measured = written(rows.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{k} double" for k in STATISTICS)), "statistics")
    train = measured.join(training_labels(labels, label_column, learn), "doc_id")
    train = written(train.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(FOLDS)).cast("int")), "labelled")
    about = train.agg(*(F.avg(k).alias(f"m_{k}") for k in STATISTICS), *(F.stddev_pop(k).alias(f"s_{k}") for k in STATISTICS)).first()
    mean = np.array([about[f"m_{k}"] or 0.0 for k in STATISTICS])
    scale = np.array([about[f"s_{k}"] or 0.0 for k in STATISTICS])
    scale[scale <= 1e-9 * np.abs(mean)] = 1  # a constant, but for rounding
    features = _Map(mean, scale)
    parts = train.mapInArrow(_summer(features), "fold int, row int, sums array<double>")
    got = parts.groupBy("fold", "row").applyInArrow(_add, "fold int, row int, sums array<double>").collect()
    if not got:
        return measured.select("doc_id", F.lit(0.5).alias("score"))
    sums = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
    for r in got:
        sums[r["fold"], r["row"]] = r["sums"]
    weights = np.stack([*(_solved(sums.sum(axis=0) - sums[k]) for k in range(FOLDS)), _solved(sums.sum(axis=0))])
    unseen = train.mapInArrow(_scorer(features, weights, None), "raw double, label double")
    bins = unseen.groupBy(F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) * (BINS / 2)).alias("bin")).agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("w")).collect()
    calibrated = Isotonic(*(np.array([float(r[k]) for r in bins]) for k in ("x", "y", "w")))
    return measured.mapInArrow(_scorer(features, weights, calibrated), "doc_id long, score double")
