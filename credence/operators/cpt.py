"""Conditional probability tables as DataFrames (var_id, config, pstate, state, p)."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..network import Model, Network, NetworkError, strides
from .counts import Family, family_counts

Unseen = Literal["uniform", "zero"]


def assignments(spark: SparkSession, cards: list[int]) -> DataFrame:
    """(config, pstate): all assignments of variables with these numbers of states, first slowest; one empty one for none."""
    total = 1
    for k in cards:
        total *= k
    digits = [(F.floor(F.col("config") / s) % k).cast("int") for s, k in zip(strides(cards), cards)]
    return spark.range(total).select(F.col("id").alias("config"), (F.array(*digits) if digits else F.array().cast("array<int>")).alias("pstate"))


def grid(spark: SparkSession, network: Network) -> DataFrame:
    """(var_id, config, pstate, state, card): every cell of every table, from the declared domains."""
    out = None
    for v in network.variables:
        cells = assignments(spark, [p.card for p in network.parents(v)]).select(F.lit(v.id).alias("var_id"), "config", "pstate", F.explode(F.sequence(F.lit(0), F.lit(v.card - 1))).alias("state"), F.lit(v.card).alias("card"))
        out = cells if out is None else out.union(cells)
    if out is None:
        raise NetworkError("the network has no variables")
    return out


def zeros(spark: SparkSession, network: Network) -> DataFrame:
    return grid(spark, network).select("var_id", "config", "pstate", "state", F.lit(0.0).alias("p"))


def fit(table: DataFrame, network: Network, unseen: Unseen = "uniform") -> DataFrame:
    """Maximum likelihood from a compressed table whose columns are the variables' names. Parent states that never occur get 1/k each, or zeros."""
    cards = {v.name: v.card for v in network.variables}
    families = [Family(v.name, tuple(p.name for p in network.parents(v))) for v in network.variables]
    counted = family_counts(table, families, cards)
    ids = F.array(*[F.lit(v.id) for v in network.variables])
    counted = counted.select(F.get(ids, F.col("family")).alias("var_id"), "config", "state", "n")
    cells = grid(table.sparkSession, network).join(counted, ["var_id", "config", "state"], "left")
    n = F.coalesce("n", F.lit(0))
    total = F.sum(n).over(Window.partitionBy("var_id", "config"))
    none = 1 / F.col("card") if unseen == "uniform" else F.lit(0.0)
    return cells.select("var_id", "config", "pstate", "state", F.when(total == 0, none).otherwise(n / total).alias("p"))


def fit_model(table: DataFrame, network: Network, unseen: Unseen = "uniform") -> Model:
    if not table.limit(1).count():
        raise NetworkError("no samples")
    return Model.from_frame(network, fit(table, network, unseen))


def where(cpt: DataFrame, network: Network, variable, condition: dict[str, int]) -> DataFrame:
    """The rows of a variable's table whose parent states agree with the whole condition; none if it names a variable that is no parent."""
    parents = [p.name for p in network.parents(variable)]
    out = cpt.filter(F.col("var_id") == network[variable].id)
    for name, state in condition.items():
        out = out.filter(F.get("pstate", F.lit(parents.index(name))) == state) if name in parents else out.filter(F.lit(False))
    return out


def patterns(cpt: DataFrame, variable_id: int) -> DataFrame:
    """All parent configurations of a variable."""
    return cpt.filter(F.col("var_id") == variable_id).select("config", "pstate").distinct()


def lookup(cpt: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (var_id, pstate, ...) with state and p, by exact match; a configuration that is not in the table raises."""
    found = asked.join(cpt.select("var_id", "pstate", "state", "p"), ["var_id", "pstate"], "left")
    miss: Column = F.raise_error(F.concat(F.lit("no row for variable "), F.col("var_id").cast("string"), F.lit(" at "), F.col("pstate").cast("string"))).cast("double")
    return found.withColumn("p", F.when(F.col("p").isNull(), miss).otherwise(F.col("p")))


def row_sums(cpt: DataFrame) -> DataFrame:
    return cpt.groupBy("var_id", "config").agg(F.sum("p").alias("total"))
