"""Connected components of an edge table: distributed union-find by star contraction.

Each round points every node at the smallest node it sees: first among its larger neighbours'
edges, then among its own (the alternating large-star and small-star steps known from the
literature). Edges never grow in number, and the rounds grow with the logarithm of the longest
path. Joins put the node with many neighbours on the side that adaptive execution splits; the
other side holds one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.llm.scratch import stored


def _least(edges: DataFrame) -> DataFrame:
    """``u, m``: the smallest of a node and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    return both.join(_least(both), "u").where("v > u").select(
        F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether every node points at one smaller node that points at none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("points")).union(
        edges.select("v", F.lit(0))).groupBy("node").agg(
        F.sum("points").alias("points"), F.count(F.lit(1)).alias("ends"))
    uneven = (F.col("points") > 1) | ((F.col("points") == 1) & (F.col("ends") > 1))
    return edges.where("v > u").isEmpty() and ends.where(uneven).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (two columns of one ordered type, no
    nulls): the component is its smallest node, which points to itself.

    Repeated edges, both directions and self-loops are allowed; without edges there are no rows.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    now = stored(pairs.where("u <> v").distinct(), "component-edges")
    while not _flat(now):
        now = stored(_small_star(stored(_large_star(now), "component-large")), "component-small")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = leaves.select("component").distinct()
    alone = pairs.where("u = v").select("u").distinct().join(
        leaves.select(F.col("node").alias("u")), "u", "left_anti")
    return leaves.union(roots.select("component", "component")).union(
        alone.select("u", "u")).distinct()
