"""Mixing sources to target weights: exact token budgets by distributed prefix sums.

Rows get hash-random keys and are range-sorted by source and key. Each range sums its own words by
source, the sums before each range give its offsets, and a running sum inside the range gives every
row's place in its source. A source's budget is whole epochs of all its rows and then a cut at the
exact word in the order of the keys.

No task gathers a source: a hot one is many ranges. Nothing comes to the driver. One task sees a row for each
source (to share out the targets), and a window over the ranges of a source sees a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscout.llm.shared import written

#: Words `[^\\x20\\x09-\\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources, in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input, and most words taken for each word of a source.
SHARE, MOST_EPOCHS = 1.5, 2
SEED = 99


def size(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key(doc_id: Column, seed: int = SEED) -> Column:
    """A hash-random key of 60 bits, of the MD5 of seed and id, so that other engines can give the same. Null: as the id "null"."""
    return F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), F.lit(15)), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Rows (source, source_size, target double) of rows (source, source_size), one for each source.

    Sources in order of code points, null last, weigh `weights`, repeating. They share `share` of all
    sizes; none gets more than `most` times its size, and the excess goes to the others by weight. With
    sources in ascending order of size / weight that is one level: those before the level are full.
    Windows here run over one row for each source.
    """
    table = F.array(*(F.lit(w) for w in weights))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rows = sizes.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * most)
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything).cast("double") * share
    rows = rows.withColumn("left", total - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("full", F.col("weight") * F.col("left") >= F.col("most") * F.col("open"))
    level = F.struct(F.row_number().over(filling), F.col("left"), F.col("open"))
    at = F.min(F.when(~F.col("full"), level)).over(everything)
    rows = rows.withColumn("at", at)
    share_of = F.col("weight") * F.col("at.left") / F.col("at.open")
    target = F.when(F.col("full") | F.col("at").isNull(), F.col("most").cast("double")).otherwise(share_of)
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of `docs`.

    `taken` are the words that the mix takes of a row, repeats counted: size times the whole epochs of
    the target, and in the last epoch all, none or the first words of it. The taken words of a source add
    up to its target, rounded down. The same rows give the same result whatever their order.

    Nulls: a null text has size 0; a null source is a source, in last place; a null id is an id. Rows
    that are alike in id, source and size stand for each other. Sources without a word get nothing. An
    empty table gives no rows. Other columns of `docs` are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), size(F.col(text_column)).alias("size"))
    rows = rows.withColumn("key", key(F.col("doc_id"), seed))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    ranges = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ranges = written(ranges, "sums")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).select(F.col("source").alias("s"), F.col("part").alias("p"), "offset")
    budgets = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    plan = offsets.join(budgets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    own = Window.partitionBy("source", "part").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0)))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - epochs * F.col("source_size") - F.col("offset") - F.col("within")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
