"""Matrices, as tables of (i, j, value) for what may be large and as arrays of arrays in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resized(m: Column, height: int, width: int, default: float = 0.0) -> Column:
    """Array form with the given shape; old cells stay, new ones are `default`."""
    cell = lambda i, j: F.coalesce(F.get(F.get(m, i), j), F.lit(float(default)))
    index = lambda n: F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    return F.transform(index(height), lambda i: F.transform(index(width), lambda j: cell(i, j)))


def height(m: Column) -> Column:
    return F.size(m)


def width(m: Column) -> Column:
    return F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))


def assigned(values: Column, rows: int, columns: int) -> Column:
    """Row-major fill from an array; null if it is too short, what is too much is ignored."""
    filled = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(values, i * columns + 1, columns))
    return F.when(F.size(values) >= rows * columns, filled)


def entry(m: Column, i: int, j: int) -> Column:
    return F.get(F.get(m, F.lit(i)), F.lit(j))


def cells(df: DataFrame, m: str) -> DataFrame:
    """(i, j, value) of the array form in column m of a one-row table."""
    rows = df.select(F.posexplode(m).alias("i", "row"))
    return rows.select("i", F.posexplode("row").alias("j", "value"))


def from_values(df: DataFrame, values: str, columns: int) -> DataFrame:
    """(i, j, value) of a row-major array in a column."""
    at = df.select(F.posexplode(values).alias("at", "value"))
    return at.select(F.floor(F.col("at") / columns).cast("int").alias("i"), (F.col("at") % columns).alias("j"), "value")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product of two tables of cells."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("value").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise product of two tables of cells."""
    return a.join(b.select("i", "j", F.col("value").alias("y")), ["i", "j"]).select("i", "j", (F.col("value") * F.col("y")).alias("value"))


def scaled(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("value", F.col("value") * F.lit(float(by)))
