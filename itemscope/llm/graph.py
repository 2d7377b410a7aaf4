"""Connected components of an edge table with DataFrame operations only.

Alternates large-star and small-star steps: each replaces a node's edges by
edges to its smallest neighbour, never makes more edges than it got and ends
with one star per component.  Hot nodes only meet a partially aggregated
``min`` and a plain sort-merge join, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemscope.llm.common import stash, unstash


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    both = _both_ways(e)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(low.select("u", F.col("m").alias("v"))).distinct())


def _are_stars(e: DataFrame) -> bool:
    """Whether every edge leads from a leaf with no other edge to a root."""
    root = e.select(F.col("v").alias("r")).distinct()
    return (e.join(root, F.col("u") == F.col("r"), "left_semi").select("u")
            .union(e.groupBy("u").count().where("count > 1").select("u")).isEmpty())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)`` for every node with an edge to another node.

    ``root`` is the component's smallest node and is listed with itself.  Self
    loops and rows with a null end are ignored; the two columns need one
    orderable type.  An empty table gives an empty table.
    """
    e = stash(edges.select("u", "v").where("u <> v")
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(e):
        before, e = e, stash(_small_star(_large_star(e)))
        unstash(before)
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
