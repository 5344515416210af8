"""The corpus operators as queries of the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, license_scan, line_dedup, mixing, near_dedup, oracles, packing, quality_model, quality_rules, secret_scan, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), "source", "text", "n_dropped")
    return out.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_md5"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def packed(docs: DataFrame, **how) -> DataFrame:
    """docs packed with the public byte-level vocabulary."""
    import public_tokenizers as public

    return packing.pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, **how)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), quality_model.graded(table(spark, sf_dir, "labels")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    places = F.transform("copies", lambda c: F.round(c["position"], 6))
    out = out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("n_copies"), F.array_min(places).alias("position"), F.array_max(places).alias("last_position"))
    # Documents that are not taken follow, spread out by their ids, so that no range of the sort holds all of them.
    return out.orderBy(F.coalesce("position", 1 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["k"] < 3)
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(F.encode(secret_scan.spelled(base), "UTF-8"), 256).alias("base_sha256"), secret_scan.spelled(F.col("spans")).alias("spans"), of(3).alias("n_random"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    spelled = F.transform("found", lambda f: F.concat_ws(":", f["license"], f["first_line"].cast("string"), f["end_line"].cast("string"), f["differing"].cast("string")))
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"]))), ",").alias("licenses"), F.array_join(spelled, ",").alias("spans"), F.array_max(F.transform("found", lambda f: f["saved"])).alias("most_saved"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_nearest_neighbours, op4_packing, op5_url_filter, op6_quality_classifier, op7_near_dedup, op8_mixing, op9_secret_scan, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
