"""Small text files by any path that Spark can read or write."""

from __future__ import annotations

from pyspark.sql import SparkSession


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    return "\n".join(r.value for r in rows)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """As a folder with one part file, as Spark writes it."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
