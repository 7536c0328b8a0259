"""Connected components by alternating large-star and small-star steps.

Each step is a minimum for each node (combined before the shuffle) and a join of the edges
with it. The minima are written before they are joined: so both sides of the join have a
shuffle of their own, and Spark can split the edges of a node with very many neighbours over
many tasks. Every round is written to the shared scratch folder and the round before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    """A digest of distinct edges; no sum, which ids near the ends of their range would overflow."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())


def _large_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    # only the neighbours above a node move to the least of its neighbourhood
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    least = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))), least


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); the component is
    the least node that can be reached. Nodes are whole numbers without nulls. The steps go on
    until none of them changes an edge, which takes a number of rounds that grows with the
    logarithm of the nodes."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.keep(edges, "edges")
    before, state = None, _state(edges)
    while state != before:
        # every pair is written with the larger node first: u > v
        large, a = _large_star(edges, scratch)
        large = scratch.keep(large.distinct(), "large")
        small, b = _small_star(large, scratch)
        after = scratch.keep(small.distinct(), "star")
        for used in (edges, a, large, b):
            scratch.drop(used)
        edges, before, state = after, state, _state(after)
    # every edge now joins a node with the least of its component
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v"), F.col("v")).distinct())
