"""Connected components by alternating large-star and small-star rounds.

Every round needs a grouped minimum (combined before the shuffle) and a join
back to it, never a node's whole neighbourhood in one place, so a node with any
number of links is safe.  Each round's edges are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm import common


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    # Large-star leaves a > b in every edge.
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, component): the least node of each component.

    Nodes that are their component's least, and nodes without edges, have no
    row.  Loops and repeated edges are harmless; edges with a null are dropped.
    """
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = common.written(tidy, "edges"), None
    while True:
        before, now = now, common.written(_small(_large(now)), "edges")
        common.dropped(before)
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
