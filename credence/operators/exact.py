"""Exact posteriors by variable elimination.

Factors are as large as the model makes them, never as the data, so they are
arrays: on the driver for one set of evidence, in the tasks for a table of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..network import Model, NetworkError, configurations

#: Cells of the largest factor that elimination may make (512 MB of doubles).
MOST_CELLS = 1 << 26

Factor = tuple[tuple[str, ...], np.ndarray]


def min_fill_order(scopes: Iterable[Sequence[str]], keep: Iterable[str]) -> list[str]:
    """The variables to eliminate, each time the one whose neighbours need the fewest new links."""
    near: dict[str, set[str]] = {}
    kept = set(keep)

    def link(names):
        for a in names:
            near.setdefault(a, set()).update(b for b in names if b != a)

    for names in scopes:
        link(names)
    order = []
    while todo := [n for n in near if n not in kept]:
        fill = {n: sum(b not in near[a] for a in near[n] for b in near[n] if a < b) for n in todo}
        best = min(todo, key=lambda n: (fill[n], len(near[n]), n))
        link(sorted(near[best]))
        for n in near.pop(best):
            near[n].discard(best)
        order.append(best)
    return order


class Elimination:
    """A model's tables as arrays, one axis for each parent and the last for the variable."""

    def __init__(self, model: Model, most: int = MOST_CELLS):
        self.network, self.most = model.network, most
        self.cards = {v.name: v.card for v in model.network.variables}
        self.factors: list[Factor] = []
        for v in model.network.variables:
            parents = model.network.parents(v)
            rows = [model.tables[v.id][c] for c in configurations(p.card for p in parents)]
            self.factors.append(((*(p.name for p in parents), v.name), np.array(rows, float).reshape(*(p.card for p in parents), v.card)))

    def checked(self, evidence: Mapping[str, int] | None) -> dict[str, int]:
        for name, code in (evidence or {}).items():
            if code is None or not 0 <= code < self.network[name].card:
                raise NetworkError(f"{name} has no state {code}")
        return dict(evidence or {})

    def product(self, factors: Sequence[Factor], left: Sequence[str]) -> np.ndarray:
        """The factors multiplied and summed over all variables but those left."""
        names = list(dict.fromkeys([*(n for f in factors for n in f[0]), *left]))
        cells = prod(self.cards[n] for n in names)
        if cells > self.most:
            raise NetworkError(f"elimination needs a factor of {cells} cells over {', '.join(names)}; {self.most} are allowed")
        place = {n: i for i, n in enumerate(names)}
        terms = [x for scope, table in factors for x in (table, [place[n] for n in scope])]
        return np.einsum(*terms, [place[n] for n in left])

    def joint(self, variables: Sequence[str], evidence: Mapping[str, int]) -> np.ndarray:
        """The unnormalised joint of some unobserved variables with the evidence, one axis each. All other variables are summed out, also where no path leads to them."""
        factors = []
        for scope, table in self.factors:
            factors.append((tuple(n for n in scope if n not in evidence), table[tuple(evidence.get(n, slice(None)) for n in scope)]))
        for name in min_fill_order([f[0] for f in factors], variables):
            own = [f for f in factors if name in f[0]]
            factors = [f for f in factors if name not in f[0]]
            left = tuple(dict.fromkeys(n for f in own for n in f[0] if n != name))
            factors.append((left, self.product(own, left)))
        out = self.product(factors[:1], factors[0][0])
        scope = factors[0][0]
        for f in factors[1:]:
            both = tuple(dict.fromkeys((*scope, *f[0])))
            scope, out = both, self.product([(scope, out), f], both)
        return self.product([(scope, out)], tuple(variables))

    def posterior(self, variable: str, evidence: Mapping[str, int]) -> np.ndarray:
        """The probabilities of a variable's states, NaN where the evidence is impossible; an observed variable has its state."""
        if variable in evidence:
            return np.eye(self.cards[variable])[evidence[variable]]
        found = self.joint([variable], evidence)
        total = found.sum()
        return found / total if total != 0 else np.full(len(found), np.nan)


def joint(spark: SparkSession, model: Model, variables: Sequence[str], evidence: Mapping[str, int] | None = None, most: int = MOST_CELLS) -> DataFrame:
    """(variables..., val): the unnormalised joint of some unobserved variables with the evidence."""
    engine = Elimination(model, most)
    evidence = engine.checked(evidence)
    if seen := [n for n in variables if n in evidence]:
        raise NetworkError(f"{', '.join(seen)} observed")
    found = engine.joint(variables, evidence)
    rows = [(*map(int, at), float(val)) for at, val in np.ndenumerate(found)]
    return spark.createDataFrame(rows, "".join(f"`{n}` int, " for n in variables) + "val double")


def posterior(spark: SparkSession, model: Model, variable: str, evidence: Mapping[str, int] | None = None, most: int = MOST_CELLS) -> DataFrame:
    """(state, p) of one variable; p is null where the evidence is impossible."""
    engine = Elimination(model, most)
    p = engine.posterior(model.network[variable].name, engine.checked(evidence))
    return spark.createDataFrame([(s, None if x != x else x) for s, x in enumerate(p.tolist())], "state int, p double")


def posteriors(spark: SparkSession, model: Model, evidence: Mapping[str, int] | None = None, most: int = MOST_CELLS) -> DataFrame:
    """(var_id, state, p) of every variable."""
    engine = Elimination(model, most)
    evidence = engine.checked(evidence)
    rows = [(v.id, s, None if x != x else x) for v in model.network.variables for s, x in enumerate(engine.posterior(v.name, evidence).tolist())]
    return spark.createDataFrame(rows, "var_id int, state int, p double")


def posteriors_of(rows: DataFrame, model: Model, query: str = "query_id", variables: Sequence[str] | None = None, most: int = MOST_CELLS) -> DataFrame:
    """(query_id, var_id, state, p) for every row of evidence, as `bp.propagate` takes it: int columns named as variables, null where unknown.

    Rows stay in their tasks; each batch eliminates once for each evidence that is different in it.
    """
    net = model.network
    observed = [v for v in net.variables if v.name in rows.columns]
    asked = [net[n] for n in variables] if variables else list(net.variables)
    engine = rows.sparkSession.sparkContext.broadcast(Elimination(model, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = np.full((n, len(observed) + 1), -1)
            for i, v in enumerate(observed):
                column = batch.column(1 + i)
                ends = pc.min_max(column).as_py()
                for code in (ends["min"], ends["max"]):
                    if code is not None:
                        engine.value.checked({v.name: code})
                codes[:, i] = column.fill_null(-1).to_numpy(zero_copy_only=False)
            distinct, of = np.unique(codes, axis=0, return_inverse=True)
            given = [{v.name: int(c) for v, c in zip(observed, line) if c >= 0} for line in distinct]
            for v in asked:
                p = np.stack([engine.value.posterior(v.name, e) for e in given])[of.reshape(-1)].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(n), v.card))), pa.array(np.full(n * v.card, v.id, np.int32)), pa.array(np.tile(np.arange(v.card, dtype=np.int32), n)), pa.array(p, mask=np.isnan(p))],
                    names=["query_id", "var_id", "state", "p"],
                )

    columns = [F.col(query).cast("long").alias("query_id"), *[F.col(f"`{v.name}`").cast("int") for v in observed]]
    return rows.select(*columns).mapInArrow(run, "query_id long, var_id int, state int, p double")
