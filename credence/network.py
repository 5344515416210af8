"""The network as an immutable value, and a network with its probability tables.

What is here lives on the driver: variables, edges and parameters of a model,
never rows of data.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import product

from pyspark.sql import DataFrame, SparkSession


class NetworkError(ValueError):
    """An operation that the network does not allow, or a table that does not fit it."""


@dataclass(frozen=True)
class Variable:
    id: int
    name: str
    card: int
    states: tuple[str, ...] = ()

    def __post_init__(self):
        if self.card < 1:
            raise NetworkError(f"{self.name}: {self.card} states")
        if self.states and len(self.states) != self.card:
            raise NetworkError(f"{self.name}: {self.card} states declared, {len(self.states)} named")


@dataclass(frozen=True)
class Network:
    """Variables with distinct ids and names, and edges (source id, target id) without a directed cycle, both in insertion order."""

    variables: tuple[Variable, ...] = ()
    edges: tuple[tuple[int, int], ...] = ()
    name: str = "network"

    @classmethod
    def of(cls, cards: Mapping[str, int], edges: Iterable[tuple[str, str]] = (), name: str = "network", first_id: int = 0) -> Network:
        """From {name: number of states} and edges by name."""
        out = cls(tuple(Variable(first_id + i, n, k) for i, (n, k) in enumerate(cards.items())), (), name)
        for a, b in edges:
            out = out.require_edge(a, b)
        return out

    @cached_property
    def _by_key(self) -> dict[int | str, Variable]:
        return {v.id: v for v in self.variables} | {v.name: v for v in self.variables}

    @cached_property
    def _parents(self) -> dict[int, list[int]]:
        place = {v.id: i for i, v in enumerate(self.variables)}
        out: dict[int, list[int]] = {v.id: [] for v in self.variables}
        for a, b in self.edges:
            out[b].append(a)
        return {v: sorted(p, key=place.__getitem__) for v, p in out.items()}

    @cached_property
    def _children(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {v.id: [] for v in self.variables}
        for v in self.variables:
            for p in self._parents[v.id]:
                out[p].append(v.id)
        return out

    def __getitem__(self, key: int | str | Variable) -> Variable:
        """A variable by id or name."""
        if isinstance(key, Variable):
            return key
        try:
            return self._by_key[key]
        except KeyError:
            raise NetworkError(f"no variable {key!r}") from None

    def __contains__(self, key) -> bool:
        return key in self._by_key

    def with_variable(self, name: str, card: int, states: Iterable[str] = ()) -> Network:
        if name in self:
            raise NetworkError(f"{name} exists")
        new = Variable(max((v.id for v in self.variables), default=-1) + 1, name, card, tuple(states))
        return replace(self, variables=(*self.variables, new))

    def can_add(self, a, b) -> bool:
        """False for an unknown variable, an existing edge, a loop or a directed cycle."""
        if not (a in self or isinstance(a, Variable)) or not (b in self or isinstance(b, Variable)):
            return False
        a, b = self[a].id, self[b].id
        return (a, b) not in self.edges and not self.reaches(b, a)

    def with_edge(self, a, b) -> Network | None:
        """The network with a -> b, or None where that is not allowed."""
        return replace(self, edges=(*self.edges, (self[a].id, self[b].id))) if self.can_add(a, b) else None

    def require_edge(self, a, b) -> Network:
        out = self.with_edge(a, b)
        if out is None:
            raise NetworkError(f"no edge {a} -> {b} can be added")
        return out

    def without_variable(self, key) -> Network | None:
        """Without the variable and its edges; None if there is none."""
        if key not in self:
            return None
        v = self[key]
        return replace(self, variables=tuple(x for x in self.variables if x is not v), edges=tuple(e for e in self.edges if v.id not in e))

    def without_edge(self, a, b) -> Network | None:
        edge = (self[a].id, self[b].id)
        return replace(self, edges=tuple(e for e in self.edges if e != edge)) if edge in self.edges else None

    def without_variables(self) -> Network:
        return replace(self, variables=(), edges=())

    def without_edges(self) -> Network:
        return replace(self, edges=())

    def with_reversed(self, a, b) -> Network | None:
        """With b -> a instead of a -> b; None if there is no such edge or a cycle would follow."""
        rest = self.without_edge(a, b)
        return rest.with_edge(b, a) if rest else None

    def parents(self, key) -> list[Variable]:
        """In the order of the variables."""
        return [self[p] for p in self._parents[self[key].id]]

    def children(self, key) -> list[Variable]:
        return [self[c] for c in self._children[self[key].id]]

    def in_edges(self, key) -> list[tuple[int, int]]:
        return [(p.id, self[key].id) for p in self.parents(key)]

    def out_edges(self, key) -> list[tuple[int, int]]:
        return [(self[key].id, c.id) for c in self.children(key)]

    def source(self, edge: tuple[int, int]) -> Variable | None:
        return self[edge[0]] if edge in self.edges else None

    def target(self, edge: tuple[int, int]) -> Variable | None:
        return self[edge[1]] if edge in self.edges else None

    def reaches(self, a, b) -> bool:
        """Whether a directed path leads from a to b; every variable reaches itself."""
        start, goal = self[a].id, self[b].id
        seen, todo = {start}, [start]
        while todo:
            at = todo.pop()
            if at == goal:
                return True
            new = set(self._children[at]) - seen
            seen |= new
            todo += new
        return False

    def topological(self) -> list[Variable]:
        """Parents first, otherwise in the order of the variables."""
        level = self.levels()
        return sorted(self.variables, key=lambda v: level[v.id])

    def levels(self) -> dict[int, int]:
        """Length of the longest path that ends in each variable."""
        left = {v.id: len(self._parents[v.id]) for v in self.variables}
        out = {v: 0 for v, n in left.items() if not n}
        todo = list(out)
        for at in todo:
            for c in self._children[at]:
                left[c] -= 1
                out[c] = max(out.get(c, 0), out[at] + 1)
                if not left[c]:
                    todo.append(c)
        return out

    def clone(self) -> Network:
        """A value needs no copy."""
        return self

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(variables, edges) as tables."""
        v = spark.createDataFrame([(x.id, x.name, x.card, list(x.states)) for x in self.variables], "var_id int, name string, card int, states array<string>")
        return v, spark.createDataFrame(list(self.edges), "src int, dst int")

    @classmethod
    def from_frames(cls, variables: DataFrame, edges: DataFrame, name: str = "network") -> Network:
        rows = sorted(variables.collect(), key=lambda r: r.var_id)
        out = cls(tuple(Variable(r.var_id, r.name, r.card, tuple(r.states or ())) for r in rows), (), name)
        for a, b in sorted((r.src, r.dst) for r in edges.collect()):
            out = out.require_edge(a, b)
        return out


def configurations(cards: Iterable[int]) -> list[tuple[int, ...]]:
    """All assignments, the first variable slowest; one empty assignment for no variables."""
    return list(product(*(range(k) for k in cards)))


def strides(cards: Iterable[int]) -> list[int]:
    """Weights of a mixed-radix number whose first digit is the slowest."""
    out, at = [], 1
    for k in reversed(list(cards)):
        out.append(at)
        at *= k
    return out[::-1]


@dataclass(frozen=True)
class Model:
    """A network and, for each variable, P(state | parents) as {parent states: probabilities}."""

    network: Network
    tables: Mapping[int, Mapping[tuple[int, ...], tuple[float, ...]]] = field(hash=False)

    def __post_init__(self):
        for v in self.network.variables:
            table = self.tables.get(v.id)
            want = set(configurations(p.card for p in self.network.parents(v)))
            if table is None or set(table) != want or any(len(r) != v.card for r in table.values()):
                raise NetworkError(f"the table of {v.name} does not fit the network")

    @classmethod
    def of(cls, network: Network, tables: Mapping[str, object]) -> Model:
        """Tables by name; each {parent states: probabilities}, a plain row for a root, a bare state for a single parent."""
        made = {}
        for name, given in tables.items():
            rows = given if isinstance(given, Mapping) else {(): given}
            made[network[name].id] = {(k if isinstance(k, tuple) else (k,)): tuple(map(float, r)) for k, r in rows.items()}
        return cls(network, made)

    def row(self, key, parent_states: tuple[int, ...] = ()) -> tuple[float, ...]:
        """Exact look-up; an unknown configuration is an error."""
        try:
            return self.tables[self.network[key].id][tuple(parent_states)]
        except KeyError:
            raise NetworkError(f"no row {parent_states} in the table of {self.network[key].name}") from None

    def is_normalised(self, tolerance: float = 1e-9) -> bool:
        return all(abs(sum(r) - 1) <= tolerance for t in self.tables.values() for r in t.values())

    def frame(self, spark: SparkSession) -> DataFrame:
        """(var_id, config, pstate, state, p); config numbers the parent states, first parent slowest."""
        rows = [(v.id, i, list(c), s, float(p)) for v in self.network.variables for i, c in enumerate(configurations(x.card for x in self.network.parents(v))) for s, p in enumerate(self.tables[v.id][c])]
        return spark.createDataFrame(rows, "var_id int, config long, pstate array<int>, state int, p double")

    @classmethod
    def from_frame(cls, network: Network, cpt: DataFrame) -> Model:
        """Collects (var_id, pstate, state, p): as many rows as the model has parameters."""
        tables: dict[int, dict[tuple[int, ...], list[float]]] = {v.id: {} for v in network.variables}
        for r in cpt.select("var_id", "pstate", "state", "p").collect():
            tables[r.var_id].setdefault(tuple(r.pstate), [0.0] * network[r.var_id].card)[r.state] = r.p
        return cls(network, {v: {c: tuple(p) for c, p in t.items()} for v, t in tables.items()})
