"""Connected components of an undirected graph, by star contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; component is the smallest node reachable.

    Alternates two contractions until every component is a star around its smallest node: every node hands its
    larger neighbours to its smallest neighbour, then its smaller neighbours. Each keeps one row per edge, so a hub
    costs rows in proportion to its links; minima are combined before the shuffle. Rounds grow with
    the logarithm of the longest path; edges that are stars from the start take none. Node type is any ordered
    type; null ends are ignored, an empty graph gives no rows.
    """
    current = scratch.save(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a != b").distinct()
    )
    while not _stars(current):
        large = scratch.save(_contract(current, larger=True))
        small = scratch.save(_contract(large, larger=False))
        scratch.drop(current, large)
        current = small
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end; its edges are distinct."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not found.where("up > 1 or up > 0 and down > 0").count()


def _contract(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction. Edges run from the larger node ``a`` to the smaller ``b``, before and after."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "node"))
    joined = both.join(least, both["a"] == least["node"])
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()
