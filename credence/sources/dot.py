"""Networks as DOT digraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network


def node(var_id: object) -> str:
    return f"Node{var_id}"


def spell(network: Network) -> str:
    """Nodes in variable order, edges in insertion order. Quotes in names are escaped."""
    out = [f"digraph {network.name}{{"]
    out += [f'    {node(v.id)} [label="{v.name.replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"];' for v in network.variables]
    out += [f"    {node(a)} -> {node(b)};" for a, b in network.edges]
    return "\n".join([*out, "}"]) + "\n"


def lines(variables: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, a, b, line): the statements as rows; kind 0 for nodes, 1 for edges."""
    name = lambda c: F.concat(F.lit("Node"), F.col(c).cast("string"))
    nodes = variables.select(F.lit(0).alias("kind"), F.col("var_id").alias("a"), F.lit(-1).alias("b"), F.concat(name("var_id"), F.lit(' [label="'), F.col("name"), F.lit('"];')).alias("line"))
    return nodes.union(edges.select(F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(name("src"), F.lit(" -> "), name("dst"), F.lit(";")).alias("line")))
