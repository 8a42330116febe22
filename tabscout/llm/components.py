"""Connected components of a graph given as an edge table, by alternating large and small stars.

Each round is two group-bys with map-side minimum and two joins on the node, whose sides are plain tables, so
that Spark splits a hub's rows over tasks; no neighbourhood is ever gathered into one row, and nothing but
a count and a checksum comes to the driver. Rounds grow with
the logarithm of the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.llm.shared import written


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each u: the smallest of u and its v. A written table, so that a join with it can split the rows of a hub."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "nearest")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = both.where("v > u").join(_nearest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _nearest(down)
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (u, v) of longs: v is the smallest node of u's component, for every u other than v.

    `edges` has longs u and v, without nulls, in any direction and with repeats. Nodes that have no edge
    to another node are not in the result; an empty table gives an empty one.
    """
    now = written(edges.where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if state == before or state["n"] == 0:
            return now
        before = state
        now = written(_small_star(written(_large_star(now), "large")), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
