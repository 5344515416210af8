"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of docs, so training order, which mixing
makes, is the order of rows in the files it writes, and packing takes it from
there.

Defined results for unusual input: a null or empty text, or one without words,
goes in the first stage; a short one is judged as any other. Null ids are never
near-duplicates. Rows that repeat an id with the same text are copies of which
mixing takes each; with different texts see `near_dedup`. Null sources are one
source. Very long texts pass whole. An empty table passes all stages. Extra
columns pass up to packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, mixing, near_dedup, quality_rules
from .common import materialize
from .queries import packed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Being short makes no document unclean: one with a word is judged by its lines and its repeats, however short."""
    return recount(quality_rules.clean(docs, min_words=1))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recount(line_dedup.dedup_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; five-word shingles, similarity 0.8 or more."""
    return near_dedup.dedup(docs, threshold=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken, in training order."""
    return mixing.schedule_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of neighbours in training order, numbered by the place of their first documents."""
    return packed(docs, in_order=True)


def recount(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str, steps: list[tuple[str, Stage]]) -> DataFrame:
    """All stages, one after the other; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(steps):
        docs = stage(spark, docs, sf_dir)
        if k < len(steps) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
