"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a class of Java's and RE2's regular expressions, and as text.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
#: A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000
#: A key with more rows than this (or than an even share of all rows among as many keys as may be broadcast) is hot.
HOT = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="credence-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once in a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of text, in order; of a null text none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")


def occurrences(text: Column, characters: str) -> Column:
    """How many code points of text are among characters. A class of ASCII characters is a bit map to the regular expression engine, and what is left without the runs of all others is found faster than what translate would take out; other classes are slow there."""
    if not characters.isascii():
        return F.length(text) - F.length(F.translate(text, characters, ""))
    return F.length(F.regexp_replace(text, "[^" + "".join("\\" + c for c in characters) + "]+", ""))


def join_hot(left: DataFrame, right: DataFrame, left_key: str, right_key: str, count: str, total: int | None = None) -> DataFrame:
    """The inner join of left, in which a key can have any number of rows, with right, which has one row a key and how many left has of it (count, dropped).

    Keys with more rows than `HOT` are joined by broadcast, where left's rows lie, and never meet in one task; the rest are joined by key. HOT grows with the rows, so that there can be no more hot keys than may be broadcast. Both are to be written tables, as they are read twice.
    """
    total = int(right.agg(F.sum(count)).first()[0] or 0) if total is None else total
    hot = F.col(count) > max(HOT, total // BROADCAST_ROWS)
    few = right.filter(hot).drop(count)
    rest = right.filter(~hot).drop(count)
    on = F.col(left_key) == F.col(right_key)
    if not few.limit(1).count():
        return left.join(rest, on)
    return left.join(F.broadcast(few), on).union(left.join(F.broadcast(few.select(right_key)), on, "left_anti").join(rest, on))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has no more than limit rows; looks at limit + 1 rows at most."""
    return df.limit(limit + 1).count() <= limit
