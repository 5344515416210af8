"""Sufficient statistics: contingency tables and the counts of many families in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..network import strides
from .discretize import checked


class Family(NamedTuple):
    """A variable and its parents, as column names."""

    target: str
    parents: tuple[str, ...] = ()


def compress(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Distinct assignments with their multiplicity n; what is counted later reads this table instead of the rows."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*columns).agg(n.cast("long").alias("n"))


def sampling_size(table: DataFrame) -> int:
    return int(table.agg(F.sum("n")).first()[0] or 0)


def mixed_radix(columns: Sequence[str], cards: dict[str, int]) -> Column:
    """The number of an assignment, the first column slowest."""
    out = F.lit(0).cast("long")
    for c, s in zip(columns, strides(cards[c] for c in columns)):
        out = out + F.col(c).cast("long") * F.lit(s)
    return out


def family_counts(table: DataFrame, families: Sequence[Family], cards: dict[str, int]) -> DataFrame:
    """(family, config, state, n): counts of every family (by its place in the list) from one scan of the compressed table. Each row is repeated for each family before the map-side aggregation, so the table is to be compressed first. A code that is null or outside its variable's domain raises, as it would be counted under another configuration."""
    table = checked(table, {c: cards[c] for f in families for c in (f.target, *f.parents)})
    each = [F.struct(F.lit(i).alias("family"), mixed_radix(f.parents, cards).alias("config"), F.col(f.target).cast("int").alias("state")) for i, f in enumerate(families)]
    rows = table.select(F.col("n"), F.explode(F.array(*each)).alias("x"))
    return rows.groupBy("x.family", "x.config", "x.state").agg(F.sum("n").cast("long").alias("n"))


def grouping_set_counts(table: DataFrame, families: Sequence[Family], columns: Sequence[str]) -> DataFrame:
    """(gid, columns..., n): the same by GROUPING SETS; the set is told by gid, not by nulls."""
    sets = [[F.col(c) for c in (*f.parents, f.target)] for f in families]
    return table.groupingSets(sets, *columns).agg(F.grouping_id().cast("long").alias("gid"), F.sum("n").cast("long").alias("n")).select("gid", *columns, "n")
