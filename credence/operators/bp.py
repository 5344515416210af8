"""Loopy belief propagation after Pearl.

`propagate` answers many evidence rows at once: messages are numpy arrays with
the rows as first axis, the model goes to every task, rows are never shuffled.
`relational` does the same rounds for one query as joins and aggregates.

Rounds are synchronous: messages from the old beliefs, beliefs from the new
messages. They end when neither messages nor beliefs move by more than epsilon,
or at `max_rounds`, which the column `converged` tells.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Literal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cut import cut
from ..network import Model

Soft = Literal["likelihood", "override"]


def normalise(x: np.ndarray) -> np.ndarray:
    """Rows divided by their sums; a row that sums to zero becomes NaN, which stands for impossible evidence."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / x.sum(axis=-1, keepdims=True)


class Propagation:
    """The arrays of a model, and the rounds."""

    def __init__(self, model: Model):
        net = model.network
        self.order = [v.id for v in net.variables]
        self.card = {v.id: v.card for v in net.variables}
        self.parents = {v.id: [p.id for p in net.parents(v)] for v in net.variables}
        self.children = {v.id: [c.id for c in net.children(v)] for v in net.variables}
        self.table = {}
        for v in net.variables:
            shape = [p.card for p in net.parents(v)] + [v.card]
            a = np.zeros(shape)
            for c, row in model.tables[v.id].items():
                a[c] = row
            self.table[v.id] = a

    def _over_parents(self, child: int, weight: dict[int, np.ndarray], skip: int | None, state: np.ndarray | None) -> np.ndarray:
        """Sum of the child's table times a weight for each parent but one, and for the child's state if given; what is left is the child's state, or the skipped parent's."""
        ps = self.parents[child]
        letters = {p: chr(ord("a") + i) for i, p in enumerate(ps)}
        own = chr(ord("a") + len(ps))
        terms, arrays = ["".join(letters[p] for p in ps) + own], [self.table[child]]
        for p in ps:
            if p != skip:
                terms.append("Z" + letters[p])
                arrays.append(weight[p])
        if state is not None:
            terms.append("Z" + own)
            arrays.append(state)
        left = letters[skip] if skip is not None else own
        batch = "Z" if len(arrays) > 1 else ""
        out = np.einsum(",".join(terms) + "->" + batch + left, *arrays, optimize=len(arrays) > 3)
        return out if batch else out[None, :]

    def run(self, hard: dict[int, np.ndarray], soft: dict[int, np.ndarray], rows: int, epsilon: float, max_rounds: int, soft_mode: Soft = "likelihood") -> tuple[dict[int, np.ndarray], np.ndarray]:
        """(belief of each variable, converged of each row). hard: states, -1 for unknown; soft: rows x states, NaN rows for none."""
        ones = lambda v: np.ones((rows, self.card[v]))
        likelihood, fixed = {}, {}
        for v in self.order:
            given = ones(v)
            frozen = np.zeros(rows, bool)
            if v in hard:
                known = hard[v] >= 0
                given[known] = np.eye(self.card[v])[hard[v][known]]
                frozen |= known
            if v in soft:
                known = ~np.isnan(soft[v]).any(axis=1)
                given[known] = soft[v][known]
                if soft_mode == "override":
                    frozen |= known
            likelihood[v], fixed[v] = given, frozen[:, None]
        pi = {v: np.where(fixed[v], likelihood[v], ones(v)) for v in self.order}
        lam = {v: likelihood[v].copy() for v in self.order}
        for v in self.order:
            if not self.parents[v]:
                pi[v] = np.where(fixed[v], pi[v], self.table[v][None, :])
        down = {(c, p): ones(p) for c in self.order for p in self.parents[c]}
        up = {(c, p): ones(p) for c in self.order for p in self.parents[c]}
        converged = np.zeros(rows, bool)
        for _ in range(max_rounds):
            new_down, new_up = {}, {}
            for c, p in down:
                # What the parent believes without this child; its own evidence counts.
                seen = pi[p] * np.where(fixed[p], 1.0, likelihood[p])
                for other in self.children[p]:
                    if other != c:
                        seen = seen * up[other, p]
                new_down[c, p] = normalise(seen)
                new_up[c, p] = normalise(np.broadcast_to(self._over_parents(c, {q: down[c, q] for q in self.parents[c]}, p, lam[c]), (rows, self.card[p])))
            new_pi, new_lam = {}, {}
            for v in self.order:
                prior = self._over_parents(v, {p: new_down[v, p] for p in self.parents[v]}, None, None)
                new_pi[v] = np.where(fixed[v], pi[v], normalise(np.broadcast_to(prior, (rows, self.card[v]))))
                told = likelihood[v]
                for c in self.children[v]:
                    told = told * new_up[c, v]
                new_lam[v] = np.where(fixed[v], lam[v], normalise(told))
            moved = np.zeros(rows)
            for new, old in ((new_down, down), (new_up, up), (new_pi, pi), (new_lam, lam)):
                for k in new:
                    moved = np.fmax(moved, np.abs(new[k] - old[k]).max(axis=1))
            down, up, pi, lam = new_down, new_up, new_pi, new_lam
            converged = moved < epsilon
            if converged.all():
                break
        return {v: normalise(pi[v] * lam[v]) for v in self.order}, converged


def propagate(rows: DataFrame, model: Model, epsilon: float = 1e-3, max_rounds: int = 200, query: str = "query_id", soft: Mapping[str, str] | None = None, soft_mode: Soft = "likelihood", variables: list[str] | None = None) -> DataFrame:
    """(query_id, var_id, state, p, converged) for every row of evidence.

    rows has the query id and an int column for each observed variable, named as it is, null where it is unknown. soft names columns of array<double> with a likelihood for each state. p is null where the evidence is impossible.
    """
    net = model.network
    observed = [v.name for v in net.variables if v.name in rows.columns]
    soft = dict(soft or {})
    asked = [net[n].id for n in variables] if variables else [v.id for v in net.variables]
    engine = rows.sparkSession.sparkContext.broadcast(Propagation(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp = engine.value
        for batch in batches:
            n = batch.num_rows
            hard = {net[v].id: batch.column(1 + i).fill_null(-1).to_numpy(zero_copy_only=False).astype(int) for i, v in enumerate(observed)}
            given = {net[v].id: np.array([x if x is not None else [np.nan] * net[v].card for x in batch.column(1 + len(observed) + i).to_pylist()], float).reshape(n, net[v].card) for i, v in enumerate(soft)}
            belief, converged = bp.run(hard, given, n, epsilon, max_rounds, soft_mode)
            ids = batch.column(0).to_numpy()
            for v in asked:
                k = bp.card[v]
                p = belief[v].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, k)), pa.array(np.full(n * k, v, np.int32)), pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(p, mask=np.isnan(p)), pa.array(np.repeat(converged, k))],
                    names=["query_id", "var_id", "state", "p", "converged"],
                )

    columns = [F.col(query).cast("long").alias("query_id"), *[F.col(c).cast("int") for c in observed], *[F.col(c) for c in soft.values()]]
    return rows.select(*columns).mapInArrow(run, "query_id long, var_id int, state int, p double, converged boolean")


def beliefs(spark: SparkSession, model: Model, evidence: Mapping[str, int] | None = None, epsilon: float = 1e-3, soft: Mapping[str, list[float]] | None = None, **how) -> DataFrame:
    """(var_id, state, p, converged) for one set of evidence."""
    evidence, soft = dict(evidence or {}), dict(soft or {})
    row = {"query_id": 0} | evidence | {f"soft_{k}": list(map(float, v)) for k, v in soft.items()}
    schema = "query_id long" + "".join(f", `{k}` int" for k in evidence) + "".join(f", `soft_{k}` array<double>" for k in soft)
    df = spark.createDataFrame([tuple(row.values())], schema)
    return propagate(df, model, epsilon, soft={k: f"soft_{k}" for k in soft}, **how).drop("query_id")


def relational(spark: SparkSession, model: Model, evidence: Mapping[str, int] | None = None, epsilon: float = 1e-9, max_rounds: int = 50) -> DataFrame:
    """(var_id, state, p) by the same rounds as joins, products and sums; hard evidence."""
    net = model.network
    given = {net[k].id: s for k, s in (evidence or {}).items()}
    cpt = model.frame(spark).select(F.col("var_id").alias("c"), "config", "pstate", "state", "p")
    links = [(v.id, p.id, i) for v in net.variables for i, p in enumerate(net.parents(v))]
    edges = spark.createDataFrame(links, "c int, r int, at int")
    #: (c, config, r, rs): the state of each parent in each configuration.
    configs = cpt.select("c", "config", "pstate").distinct().join(F.broadcast(edges), "c").select("c", "config", "r", F.get("pstate", F.col("at")).alias("rs"))
    domain = spark.createDataFrame([(v.id, s, float(given.get(v.id, s) == s), v.id in given, not net.parents(v)) for v in net.variables for s in range(v.card)], "v int, state int, fits double, known boolean, root boolean")
    share = lambda df, *by: df.withColumn("val", F.col("val") / F.sum("val").over(Window.partitionBy(*by)))
    prior = cpt.join(domain.filter("root").select(F.col("v").alias("c"), "state"), ["c", "state"]).select(F.col("c").alias("v"), "state", "p")
    pi = domain.join(prior, ["v", "state"], "left").select("v", "state", F.when(F.col("known"), F.col("fits")).otherwise(F.coalesce("p", F.lit(1.0))).alias("val"))
    lam = domain.select("v", "state", F.col("fits").alias("val"))
    ends = edges.select("c", "r").join(domain.select(F.col("v").alias("r"), F.col("state").alias("rs")), "r")
    down = ends.select("c", "r", "rs", F.lit(1.0).alias("val"))
    up = down

    def step(down: DataFrame, up: DataFrame, pi: DataFrame, lam: DataFrame):
        # pi messages: the parent's pi times the lambda messages of its other children
        others = ends.alias("e").join(up.alias("u"), (F.col("e.r") == F.col("u.r")) & (F.col("e.rs") == F.col("u.rs")) & (F.col("e.c") != F.col("u.c")), "left")
        others = others.groupBy("e.c", "e.r", "e.rs").agg(F.product(F.coalesce("u.val", F.lit(1.0))).alias("o"))
        new_down = share(others.join(pi.select(F.col("v").alias("r"), F.col("state").alias("rs"), F.col("val").alias("x")), ["r", "rs"]).select("c", "r", "rs", (F.col("o") * F.col("x")).alias("val")), "c", "r")
        # lambda messages: over configurations, the child's lambda through its table times the other parents' pi messages
        seen = cpt.join(lam.select(F.col("v").alias("c"), "state", F.col("val").alias("x")), ["c", "state"]).groupBy("c", "config").agg(F.sum(F.col("p") * F.col("x")).alias("x"))
        told = configs.join(down, ["c", "r", "rs"]).select("c", "config", F.col("r").alias("q"), "val")
        rest = configs.join(told, ["c", "config"], "left").groupBy("c", "config", "r", "rs").agg(F.product(F.when(F.col("q") != F.col("r"), F.col("val")).otherwise(1.0)).alias("w"))
        new_up = share(rest.join(seen, ["c", "config"]).groupBy("c", "r", "rs").agg(F.sum(F.col("w") * F.col("x")).alias("val")), "c", "r")
        # beliefs from the new messages
        weight = configs.join(new_down, ["c", "r", "rs"]).groupBy("c", "config").agg(F.product("val").alias("w"))
        by_table = cpt.join(weight, ["c", "config"], "left").groupBy(F.col("c").alias("v"), "state").agg(F.sum(F.col("p") * F.coalesce("w", F.lit(1.0))).alias("val"))
        new_pi = domain.join(share(by_table, "v"), ["v", "state"]).select("v", "state", F.when(F.col("known"), F.col("fits")).otherwise(F.col("val")).alias("val"))
        told_up = domain.join(up_by_node(new_up), ["v", "state"], "left").select("v", "state", F.when(F.col("known"), F.col("fits")).otherwise(F.coalesce("val", F.lit(1.0))).alias("val"))
        return new_down, new_up, new_pi, share(told_up, "v")

    def up_by_node(messages: DataFrame) -> DataFrame:
        return messages.groupBy(F.col("r").alias("v"), F.col("rs").alias("state")).agg(F.product("val").alias("val"))

    def moved(new: DataFrame, old: DataFrame, on: list[str]) -> float:
        return new.join(old.withColumnRenamed("val", "was"), on).agg(F.max(F.abs(F.col("val") - F.col("was")))).first()[0] or 0.0

    for _ in range(max_rounds):
        new = [cut(x) for x in step(down, up, pi, lam)]
        far = max(moved(n, o, on) for n, o, on in zip(new, (down, up, pi, lam), (["c", "r", "rs"], ["c", "r", "rs"], ["v", "state"], ["v", "state"])))
        down, up, pi, lam = new
        if far < epsilon:
            break
    both = pi.join(lam.withColumnRenamed("val", "y"), ["v", "state"]).select(F.col("v").alias("var_id"), "state", (F.col("val") * F.col("y")).alias("val"))
    total = F.sum("val").over(Window.partitionBy("var_id"))
    return both.select("var_id", "state", F.when(total != 0, F.col("val") / total).alias("p"))
