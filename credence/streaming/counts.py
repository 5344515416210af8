"""Sufficient statistics of a stream: the counts behind the tables, kept up to date as rows arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..network import Network
from ..operators.counts import Family, mixed_radix
from ..operators.cpt import Unseen, fit
from ..operators.discretize import checked


def family_counts(stream: DataFrame, families: Sequence[Family], cards: dict[str, int]) -> DataFrame:
    """(family, config, state, n) over all rows so far; for update or complete mode. State is one row for each cell seen. A code outside its variable's domain stops the query."""
    stream = checked(stream, {c: cards[c] for f in families for c in (f.target, *f.parents)})
    each = [F.struct(F.lit(i).alias("family"), mixed_radix(f.parents, cards).alias("config"), F.col(f.target).cast("int").alias("state")) for i, f in enumerate(families)]
    return stream.select(F.explode(F.array(*each)).alias("x")).groupBy("x.family", "x.config", "x.state").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, columns: Sequence[str], time: str, window: str, late: str) -> DataFrame:
    """Contingency tables by event-time window; rows later than `late` are dropped and closed windows leave the state."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *columns).agg(F.count("*").alias("n"))


def fit_stream(stream: DataFrame, network: Network, on_tables: Callable[[DataFrame, int], None], checkpoint: str, unseen: Unseen = "uniform", **trigger) -> StreamingQuery:
    """Starts a query that hands the refitted tables to on_tables(cpt, batch) after each batch. A batch refits from the counts of all rows so far, so a replayed batch gives the same tables."""
    names = [v.name for v in network.variables]
    table = stream.groupBy(*names).agg(F.count("*").alias("n"))
    query = table.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: on_tables(fit(df, network, unseen), batch))
    return query.trigger(**(trigger or {"availableNow": True})).start()
