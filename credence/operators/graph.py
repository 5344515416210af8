"""Set-based operations on networks kept as tables: variables (var_id, ...) and edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut
from ..network import NetworkError


def children(edges: DataFrame) -> DataFrame:
    """(var_id, children) for every variable that has some, in id order."""
    return edges.groupBy(F.col("src").alias("var_id")).agg(F.sort_array(F.collect_list("dst")).alias("children"))


def parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("var_id")).agg(F.sort_array(F.collect_list("src")).alias("parents"))


def reach(variables: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) for every pair joined by a directed path, and every variable with itself.

    Paths double in length each round, so the rounds are the logarithm of the longest path; a network's closure is at most the square of its variables.
    """
    own = variables.select(F.col("var_id").alias("src"), F.col("var_id").alias("dst"))
    now = cut(own.union(edges.select("src", "dst")).distinct())
    size = now.count()
    while True:
        longer = now.select("src", F.col("dst").alias("mid")).join(now.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        longer = cut(longer)
        n = longer.count()
        if n == size:
            return longer
        now, size = longer, n


def addable(variables: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) of every edge that may be added: not there yet and closing no cycle."""
    ids = variables.select("var_id")
    pairs = ids.select(F.col("var_id").alias("src")).crossJoin(ids.select(F.col("var_id").alias("dst")))  # variables of a network, not rows of data
    back = reach(variables, edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.join(back, ["src", "dst"], "left_anti").join(edges, ["src", "dst"], "left_anti")


def without_variable(variables: DataFrame, edges: DataFrame, var_id: int) -> tuple[DataFrame, DataFrame]:
    return variables.filter(F.col("var_id") != var_id), edges.filter((F.col("src") != var_id) & (F.col("dst") != var_id))


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["src", "dst"], "left_anti")


def reversed_edge(edges: DataFrame, src: int, dst: int) -> DataFrame:
    """Edges with src -> dst turned round; the same edges if that would close a cycle or there is no such edge."""
    here = (F.col("src") == src) & (F.col("dst") == dst)
    rest = edges.filter(~here)
    ends = rest.select(F.col("src").alias("var_id")).union(rest.select(F.col("dst").alias("var_id"))).distinct()
    cycle = reach(ends, rest).filter(here).limit(1).count() > 0
    if cycle or not edges.filter(here).limit(1).count():
        return edges
    return edges.select(F.when(here, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(here, F.col("src")).otherwise(F.col("dst")).alias("dst"))


def levels(variables: DataFrame, edges: DataFrame) -> DataFrame:
    """(var_id, level): length of the longest path that ends in each variable; parents come first by level.

    Longest paths between all pairs double in length each round, as in `reach`; edges that form a cycle raise.
    """
    most = variables.count()
    now = cut(edges.select("src", "dst", F.lit(1).alias("far")).distinct())
    done = None
    while True:
        first, then = now.select("src", F.col("dst").alias("mid"), F.col("far").alias("x")), now.select(F.col("src").alias("mid"), "dst", F.col("far").alias("y"))
        both = first.join(then, "mid").select("src", "dst", (F.col("x") + F.col("y")).alias("far")).union(now)
        now = cut(both.groupBy("src", "dst").agg(F.max("far").alias("far")))
        told = tuple(now.agg(F.count("*"), F.sum("far"), F.max("far")).first())
        if told[0] and told[2] >= most:
            raise NetworkError("the edges form a cycle")
        if told == done:
            break
        done = told
    ends = now.groupBy("dst").agg(F.max("far").alias("level"))
    return variables.join(ends, F.col("var_id") == F.col("dst"), "left").select("var_id", F.coalesce("level", F.lit(0)).alias("level"))
