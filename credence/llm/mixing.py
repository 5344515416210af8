"""Mixing sources to target weights along a curriculum.

Sizes are words. The sources, in code-point order with null last, take the
weights in turn; the total is a given share of all words, divided by weight,
and no source exceeds `max_epochs` times its size: what it cannot take is
shared again by weight among the rest (water filling; one aggregate over the
sources for each step). Within a source the documents stand in the order of a
digest of id and text, pass after pass; a word is taken if it comes before the
source's target, so a source takes exactly its target, to the nearest word.

When it is taken follows from the source's schedule: a piecewise linear rate
over training time 0..1 with mean 1. Its integral is the share of the source's
demand met by then, and inverting it at the middle of a document's interval of
the cumulative demand gives the document's training position. `mix` range-sorts
by that position.

Running sums need no group in one task: each source is cut into buckets by the
digest, about `ROWS_PER_BUCKET` rows each, summed within buckets, and the sums
of the buckets are added up.

Defined results for unusual input: a null text has size 0 and takes nothing; a
null source is a source; a very long text is one document of its size; identical
rows count separately, and which of them takes more is left open, as nothing tells
them apart; an empty table gives an empty result; columns of df with reserved names (leading underscore) are
safe because rows travel in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, small, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
#: One schedule for each weight: (time, rate) from 0 to 1; they are scaled to mean 1.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
ROWS_PER_BUCKET = 1000
MOST_BUCKETS = 1 << 20


def digest(id_: Column, text: Column) -> Column:
    """The order within a source: md5 in hex of id, a colon and the text."""
    return F.md5(F.encode(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))), "UTF-8"))


def position(u: Column, schedule) -> Column:
    """Training time at which the share u of a source's demand is met."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
    mean, done, out = sum(area), 0.0, None
    for (t, r), (t2, r2), part in zip(schedule, schedule[1:], area):
        rest = u * mean - done  # area into this piece: r x + slope x^2 / 2
        slope = (r2 - r) / (t2 - t)
        x = rest / r if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), r * r + 2 * slope * rest)) - r) / slope
        done += part
        out = F.when(u * mean <= done, t + x) if out is None else out.when(u * mean <= done, t + x)
    return F.least(out.otherwise(F.lit(1.0)), F.lit(1.0))


def ranked(df: DataFrame, column: str) -> DataFrame:
    """df with _rank, from 0, by column with null last: a range sort and the sizes of its partitions."""
    dealt = materialize(df.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("_pid", F.spark_partition_id()), "ranked")
    before = dealt.groupBy("_pid").count().select(F.col("_pid").alias("_p"), (F.sum("count").over(Window.orderBy("_pid")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_pid").orderBy(F.col(column).asc_nulls_last())) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(before), F.col("_pid") == F.col("_p")).withColumn("_rank", F.col("_within") + F.col("_before")).drop("_pid", "_p", "_before", "_within")


def level(sources: DataFrame, total: float, max_epochs: float = MAX_EPOCHS) -> float:
    """The common target per weight at which the sources' targets, each at most max_epochs times its size, add up to total."""
    weight, cap = F.col("weight"), F.col("source_size") * F.lit(float(max_epochs))
    now = 0.0
    while True:
        full = F.lit(now) * weight >= cap
        capped, free = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(weight))).first()
        if capped is None:
            return now
        new = (total - capped) / free if free else now
        if not free or new <= now:
            return now
        now = new


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, rows, turn (which weight), target."""
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    turn = (F.col("_rank") % len(weights)).cast("int")
    listed = materialize(ranked(sources, "source").select("source", "source_size", "rows", turn.alias("turn"), F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight")), "weights")
    total = (listed.agg(F.sum("source_size")).first()[0] or 0) * share
    per_weight = level(listed, total, max_epochs)
    return listed.withColumn("target", F.least(F.col("weight") * F.lit(per_weight), F.col("source_size") * F.lit(float(max_epochs))))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES, carry: list[str] | None = None) -> DataFrame:
    """One row per row of df: row (a struct of the carried columns), source, size, source_size, target, taken, and copies, an array of (taken, position, begins: the source's words before it), one for each pass that takes words."""
    carry = [id_col] if carry is None else carry
    sized = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), digest(F.col(id_col), F.col(text_col)).alias("h"))
    if text_col not in carry:  # texts are read again rather than written once more
        sized = materialize(sized, "sized")
    aims = materialize(targets(sized, weights, share, max_epochs), "targets")
    count = aims.agg(F.sum("rows")).first()[0] or 0
    per_bucket = max(ROWS_PER_BUCKET, count // MOST_BUCKETS)
    aims = aims.select(F.col("source").alias("_s"), "source_size", "target", "turn", F.ceil(F.col("rows") / per_bucket).alias("_buckets"))
    aims = F.broadcast(aims) if small(aims) else aims
    dealt = sized.join(aims, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    dealt = dealt.withColumn("bucket", F.pmod(F.conv(F.substring("h", 1, 12), 16, 10).cast("long"), F.col("_buckets"))).drop("_buckets")
    parts = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    parts = materialize(parts.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")), "buckets")
    parts = parts.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "before")
    parts = F.broadcast(parts) if small(parts) else parts
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    summed = dealt.withColumn("inside", inside).join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    goal = F.floor(F.col("target") + 0.5)
    start = F.col("inside") + F.col("before")

    def of(epoch: Column) -> Column:
        begins = start + epoch * F.col("source_size")
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - begins))
        return let(taken, lambda k: F.struct(k.alias("taken"), _position(F.try_divide(begins + k / 2, F.col("target")), schedules).alias("position"), begins.alias("begins")))

    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max_epochs - 1).cast("long")), of), lambda c: c["taken"] > 0)
    out = summed.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["taken"])
    return out.select("row", "source", "size", "source_size", "target", taken.alias("taken"), "copies")


def _position(u: Column, schedules) -> Column:
    out = F.when(F.col("turn") == 0, position(u, schedules[0]))
    for k, s in enumerate(schedules[1:], 1):
        out = out.when(F.col("turn") == k, position(u, s))
    return out


def schedule_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of df in training order, each as often as it is taken; a last pass that takes less than half of a document leaves it out, unless it is the source's first and nothing else would stay of that source."""
    mixed = mix(df, id_col, text_col, source_col, carry=df.columns, **how)
    one = mixed.select("row", "size", F.explode("copies").alias("c")).filter((F.col("c.taken") * 2 >= F.col("size")) | (F.col("c.begins") == 0))
    return one.orderBy("c.position").select(*[F.col("row")[c].alias(c) for c in df.columns])
