"""Uniform numbers from counters: the same in every run, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, index: Column, name: str) -> Column:
    """A double in [0, 1) from 52 bits of md5('seed:index:name')."""
    key = F.concat(F.lit(f"{seed}:"), index.cast("string"), F.lit(f":{name}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


def uniform_sql(seed: int, index: str, name: str) -> str:
    """The same in DuckDB's SQL."""
    return f"(cast('0x' || substr(md5('{seed}:' || {index} || ':{name}'), 1, 13) AS bigint) / 4503599627370496e0)"
