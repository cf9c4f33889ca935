"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the smallest node that is reachable.

    Each step replaces the edges of a node by edges to its smallest neighbour
    (Kiveris et al. 2014), so the number of rounds is logarithmic and no node's
    neighbours are gathered: a minimum is aggregated before the shuffle, and the
    join back to the edges is one whose large partitions Spark can split. Every
    round is a written table. Nulls and loops are left out; empty edges give an
    empty table.
    """
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _settled(now):
        both = scratch.save(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.save(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        scratch.drop(low, now, both)
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.save(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(low, large)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return scratch.save(out.unionByName(out.select(F.col("component").alias("node"), "component").distinct()))


def _settled(edges: DataFrame) -> bool:
    """Every edge leads from a node with no other edge to one that leads nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()
