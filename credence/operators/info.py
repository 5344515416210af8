"""Entropy and mutual information of the empirical distribution, in bits."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counts import mixed_radix
from .discretize import checked


def entropies(table: DataFrame, sets: Sequence[Sequence[str]], cards: dict[str, int]) -> DataFrame:
    """(place, entropy) of each set of variables, all in one job over the compressed table. Null codes and codes outside their domains raise."""
    table = checked(table, {c: cards[c] for s in sets for c in s})
    each = [F.struct(F.lit(i).alias("place"), mixed_radix(list(s), cards).alias("cell")) for i, s in enumerate(sets)]
    cells = table.select("n", F.explode(F.array(*each)).alias("x")).groupBy("x.place", "x.cell").agg(F.sum("n").cast("double").alias("m"))
    return cells.groupBy("place").agg((F.log2(F.sum("m")) - F.sum(F.col("m") * F.log2("m")) / F.sum("m")).alias("entropy"))


def mutual_information(hx: float | Column, hy: float | Column, hxy: float | Column):
    return hx + hy - hxy


def mi_matrix(table: DataFrame, variables: Sequence[str], cards: dict[str, int]) -> DataFrame:
    """(a, b, mi) for every pair of variables, in the order given."""
    pairs = list(combinations(variables, 2))
    spark = table.sparkSession
    h = entropies(table, [[v] for v in variables] + [list(p) for p in pairs], cards)
    place = {v: i for i, v in enumerate(variables)}
    of = spark.createDataFrame([(len(variables) + i, a, b, place[a], place[b]) for i, (a, b) in enumerate(pairs)], "place int, a string, b string, pa int, pb int")
    single = lambda c: h.select(F.col("place").alias(c), F.col("entropy").alias(f"h_{c}"))
    joined = of.join(h, "place").join(single("pa"), "pa").join(single("pb"), "pb")
    return joined.select("a", "b", mutual_information(F.col("h_pa"), F.col("h_pb"), F.col("entropy")).alias("mi"))


def strongest_pair(mi: DataFrame) -> DataFrame:
    """The pair with the largest mutual information."""
    return mi.orderBy(F.desc("mi"), "a", "b").limit(1)


def linkage(mi: DataFrame, clusters: DataFrame) -> DataFrame:
    """(ca, cb, similarity): mean mutual information between the members of clusters (variable, cluster)."""
    both = mi.union(mi.select(F.col("b").alias("a"), F.col("a").alias("b"), "mi"))
    x, y = (clusters.select(F.col("variable").alias(v), F.col("cluster").alias(f"c{v}")) for v in "ab")
    return both.join(F.broadcast(x), "a").join(F.broadcast(y), "b").filter("ca < cb").groupBy("ca", "cb").agg(F.avg("mi").alias("similarity"))


def average_similarity(mi: DataFrame) -> DataFrame:
    return mi.agg(F.avg("mi").alias("average"))


def normalised(df: DataFrame, groups: Sequence[str], value: str, guard: bool = False, least: float = 1e-20) -> DataFrame:
    """value divided by its sum within each group. A sum of zero gives null, or with guard (sums under `least`) equal shares."""
    w = Window.partitionBy(*groups)
    total = F.sum(value).over(w)
    share = F.when(total < least, 1 / F.count("*").over(w)).otherwise(F.col(value) / total) if guard else F.when(total != 0, F.col(value) / total)
    return df.withColumn(value, share)
