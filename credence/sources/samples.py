"""Sample files: states separated by white space, one sample a line, with or without a multiplicity in front."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_samples(spark: SparkSession, path: str, columns: Sequence[str], weight_first: bool = False) -> DataFrame:
    """The named int columns in file order; with weight_first equal rows are summed and n is their multiplicity, without it every line stays a row.

    Blank lines are skipped. A line with another number of fields, or with something that is no integer, raises.
    """
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(path).select(F.col("value"), fields.alias("f")).filter(F.trim("value") != "")
    want = len(columns) + weight_first
    line = F.when(F.size("f") == want, F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"not {want} fields: "), F.col("value"))).cast("array<string>"))
    numbers = lines.select(F.transform(line, lambda x: x.cast("long")).alias("f"))
    named = [F.get("f", F.lit(i + weight_first)).cast("int").alias(c) for i, c in enumerate(columns)]
    if not weight_first:
        return numbers.select(*named)
    return numbers.select(*named, F.get("f", F.lit(0)).alias("n")).groupBy(*columns).agg(F.sum("n").alias("n"))


def write_samples(df: DataFrame, path: str, columns: Sequence[str], weight: str | None = None) -> None:
    named = ([weight] if weight else []) + list(columns)
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in named]).alias("value")).write.text(path)
