"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_hot, materialize


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least neighbour of u; least (w, m, c) has one row a node and is sent to the edges where it is short, and where not, nodes with many edges are."""
    if least.count() <= BROADCAST_ROWS:
        return edges.join(F.broadcast(least.drop("c")), F.col("u") == F.col("w")).drop("w")
    return join_hot(edges, least, "u", "w", "c").drop("w")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"), "c"), "least")
    return _joined(both.filter(F.col("v") > F.col("u")), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges go from the larger to the smaller node."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).withColumnRenamed("u", "w"), "least")
    moved = _joined(edges, least)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node reachable. Roots themselves are not listed."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    now = materialize(down, "edges")
    for _ in range(max_rounds):
        # Stars of depth one: no root is anyone's child, and each child has one root.
        roots, children = now.select(F.col("v").alias("u")).distinct(), now.select("u")
        if not now.limit(1).count() or (roots.join(children, "u", "left_semi").limit(1).count() == 0 and children.groupBy("u").count().filter("count > 1").limit(1).count() == 0):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = materialize(_large_star(now), "edges")
        now = materialize(_small_star(now), "edges")
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
