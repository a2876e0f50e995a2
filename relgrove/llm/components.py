"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgrove.llm.common import checkpointed


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = checkpointed(least)  # so that both sides of the join are shuffled for it, and it may split the edges of a hot node
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge to another; root is the component's least node.

    edges: (u, v), in any order, repeated or not. The rounds needed grow with
    the logarithm of the longest chain. Per round, the edges shrink or stay;
    nothing but two sums comes to the driver. A node that is linked to a third
    of all others is a key of two aggregations with map-side combining and of
    a join that adaptive execution may split.
    """
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = checkpointed(e), None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark == seen or mark[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        e = checkpointed(_small_star(_large_star(e).distinct()).distinct())
