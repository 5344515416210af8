"""Site-relative line dedup.

For every host the number of pages that contain a line is divided by the
host's number of pages; a line above the ratio is boilerplate of that host and
is taken out of its pages. Lines travel as 128-bit digests, one for each page
and line, and are counted on the map side first; texts are never shuffled
when the boilerplate found is small (its rows are counted), and once when not.

Defined results for unusual input: null hosts form one site; a null or empty
text has no lines and passes unchanged; lines without a word are never
counted or dropped; repeated rows count as pages of their own; a line on one
page of its host stays, as no ratio means anything there, and from two pages on
the ratio alone decides at every size of a host (`min_pages` and `min_count`
can ask for more); a very long text is cleaned whole; lines are equal or not, so
there are no ties; an empty table gives an empty result; other columns pass
through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, small

MAX_RATIO = 0.1
MIN_PAGES = 2
MIN_COUNT = 2


def _has_word(line: Column) -> Column:
    return line.rlike(f"[^{SPACE[1:-1]}]")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.encode(line, "UTF-8")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, min_count: int = MIN_COUNT) -> DataFrame:
    """host, line (digest), pages with the line, pages of the host, for every boilerplate line."""
    pages = df.select(F.col(host_col).alias("host"), F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), _has_word), _digest)).alias("lines"))
    # One count for both: the null line stands for the page itself.
    marked = pages.select("host", F.explode(F.concat(F.array(F.lit(None).cast("binary")), F.col("lines"))).alias("line"))
    counts = materialize(marked.groupBy("host", "line").agg(F.count("*").alias("pages")).filter((F.col("pages") >= min_count) | F.col("line").isNull()), "line-counts")
    totals = counts.filter(F.col("line").isNull()).select(F.col("host").alias("h"), F.col("pages").alias("total")).filter(F.col("total") >= min_pages)
    totals = F.broadcast(totals) if small(totals) else totals
    found = counts.filter(F.col("line").isNotNull()).join(totals, F.col("host").eqNullSafe(F.col("h")))
    return found.filter(F.col("pages") > F.lit(max_ratio) * F.col("total")).select("host", "line", "pages", "total")


def dedup_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", count_col: str | None = None, **limits) -> DataFrame:
    """df with the boilerplate lines of each host taken out of its texts; count_col, if named, has how many."""
    found = materialize(boilerplate(df, host_col, text_col, **limits).select("host", "line"), "line-boilerplate")
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(host_col).alias("_host"), _lines(F.col(text_col)).alias("_l"))
    if small(found):
        # A host has fewer than (lines of a page) / max_ratio such lines, so each list is short.
        lists = F.broadcast(found.groupBy(F.col("host").alias("_h")).agg(F.collect_set("line").alias("_bad")))
        joined = row.join(lists, F.col("_host").eqNullSafe(F.col("_h")), "left")
        good = F.filter("_l", lambda x: ~let(_digest(x), lambda d: F.array_contains(F.col("_bad"), d)))
        out = joined.select("_row", "_l", F.when(F.col("_bad").isNull(), F.col("_l")).otherwise(good).alias("_good"))
    else:
        out = _by_shuffle(row, found)
    text = F.when(F.size("_good") == F.size("_l"), F.col("_row")[text_col]).otherwise(F.concat_ws("\n", "_good"))
    return out.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in df.columns], *([(F.size("_l") - F.size("_good")).cast("long").alias(count_col)] if count_col else []))


def _by_shuffle(row: DataFrame, found: DataFrame) -> DataFrame:
    """The same where the boilerplate is too large to send everywhere: the bad lines of each page are found by digest and brought back to the page."""
    keyed = materialize(row.withColumn("_key", F.expr("uuid()")), "line-pages")
    pairs = keyed.select("_key", "_host", F.explode(F.array_distinct(F.transform("_l", _digest))).alias("_d"))
    hits = pairs.join(found.withColumnRenamed("host", "_h"), (F.col("_d") == F.col("line")) & F.col("_host").eqNullSafe(F.col("_h")))
    lists = hits.groupBy(F.col("_key").alias("_k")).agg(F.collect_set("_d").alias("_bad"))
    joined = keyed.join(lists, F.col("_key") == F.col("_k"), "left")
    good = F.filter("_l", lambda x: ~let(_digest(x), lambda d: F.array_contains(F.col("_bad"), d)))
    return joined.select("_row", "_l", F.when(F.col("_bad").isNull(), F.col("_l")).otherwise(good).alias("_good"))
