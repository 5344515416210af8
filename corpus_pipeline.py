"""The corpus pipeline: five stages, each of which works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credence.llm import pipeline as stages

STAGES = stages.STAGES
ORACLE_SQL = None  # near-dedup and packing have no SQL; tests/llm checks the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir, STAGES)
