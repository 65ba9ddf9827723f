"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colorway.llm.common import lineage_cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the smallest node of
    its component. Hot nodes are never gathered: a node's smallest neighbour is
    an aggregate, and goes back to its edges by a join that Spark splits where
    it is skewed. Every step's edges are written to the checkpoint folder; the
    driver sees a count and a checksum. Self edges only name a node; null ends
    are left out."""
    known = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    nodes = known.select(F.col("a").alias("node")).union(known.select("b")).distinct()
    now = lineage_cut(known.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")),
                                                              F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")) \
            .select("e.a", "e.b").where("a != b").distinct()
        now = lineage_cut(small)
        before, state = state, _state(now)
        if state == before:
            break
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("low")), "node", "left") \
        .select("node", F.coalesce("low", "node").alias("root"))
