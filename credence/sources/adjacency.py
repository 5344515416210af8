"""Edges as a CSV grid: a header of ids, and a `*` in row i, column j for the edge i -> j (a space for none). Rows and columns count by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..network import Network


def load(lines: DataFrame, variables: DataFrame) -> DataFrame:
    """(src, dst) from a table of lines (line_no from 0 for the header, value); variables gives the ids (position from 0, var_id)."""
    cells = lines.filter(F.col("line_no") > 0).select((F.col("line_no") - 1).cast("int").alias("i"), F.posexplode(F.split("value", ",", -1)).alias("field", "mark"))
    marked = cells.filter((F.col("mark") == "*") & (F.col("field") > 0)).select("i", (F.col("field") - 1).alias("j"))
    by = lambda c, name: F.broadcast(variables.select(F.col("position").alias(c), F.col("var_id").alias(name)))
    return marked.join(by("i", "src"), "i").join(by("j", "dst"), "j").select("src", "dst")


def read(spark: SparkSession, path: str, network: Network) -> Network:
    """The network's variables with the file's edges; an edge that would close a cycle is left out."""
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()][0].splitlines()
    for i, line in enumerate(lines[1 : len(network.variables) + 1]):
        for j, mark in enumerate(line.split(",")[1 : len(network.variables) + 1]):
            if mark == "*":
                network = network.with_edge(network.variables[i], network.variables[j]) or network
    return network


def spell(variables: DataFrame, edges: DataFrame) -> DataFrame:
    """(line_no, value): the lines of the grid, in id order."""
    ids = variables.select("var_id")
    full = ids.select(F.col("var_id").alias("src")).crossJoin(ids.select(F.col("var_id").alias("dst")))  # a network's variables
    cells = full.join(edges.select("src", "dst", F.lit("*").alias("mark")), ["src", "dst"], "left")
    rows = cells.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", F.coalesce("mark", F.lit(" ")).alias("m")))).alias("r"))
    body = rows.select(F.col("src"), F.concat(F.col("src").cast("string"), F.lit(","), F.array_join(F.transform("r", lambda x: x["m"]), ",")).alias("value"))
    head = ids.agg(F.sort_array(F.collect_list("var_id")).alias("r")).select(F.lit(None).cast("int").alias("src"), F.concat(F.lit(","), F.array_join(F.transform("r", lambda x: x.cast("string")), ",")).alias("value"))
    number = F.coalesce(F.size(F.filter(F.col("ids"), lambda x: x <= F.col("src"))), F.lit(0))
    every = ids.agg(F.collect_list("var_id").alias("ids"))
    return head.union(body).crossJoin(every).select(F.when(F.col("src").isNull(), 0).otherwise(number).cast("int").alias("line_no"), "value")
