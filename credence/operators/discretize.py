"""Columns to state codes. Domains are declared, never taken from the rows of a partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(column: Column, domain: Sequence[str]) -> Column:
    """The place of a string in its declared domain; null where it is not in it."""
    at = F.array_position(F.array(*[F.lit(x) for x in domain]), column) - 1
    return F.when(at >= 0, at).cast("int")


def width(column: Column, origin: float, step: float, bins: int) -> Column:
    """floor((x - origin) / step), held to 0 .. bins - 1."""
    return F.least(F.greatest(F.floor((column - origin) / step), F.lit(0)), F.lit(bins - 1)).cast("int")


def log2_width(column: Column, bins: int) -> Column:
    """floor(log2 x), at most bins - 1; x < 1 gives 0."""
    return F.least(F.floor(F.log2(F.greatest(column, F.lit(1)).cast("double"))), F.lit(bins - 1)).cast("int")


def rounded(column: Column, factor: float) -> Column:
    return F.round(column * factor).cast("int")


def checked(df: DataFrame, cards: dict[str, int]) -> DataFrame:
    """df; a code that is null or outside 0 .. card - 1 raises when it is read."""
    out = {}
    for c, k in cards.items():
        bad = F.concat(F.lit(f"{c}: code "), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(f" is not in 0..{k - 1}"))
        out[c] = F.when(F.col(c).between(0, k - 1), F.col(c)).otherwise(F.raise_error(bad).cast("int"))
    return df.withColumns(out)


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows without a missing value; `df.count() - complete(df).count()` is what was left out."""
    return df.dropna(subset=list(columns))
