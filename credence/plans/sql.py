"""SQL for DuckDB that says what the operators do, built from the same networks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from ..functions.hashing import uniform_sql
from ..network import Model, Network, configurations, strides


def number(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def values(rows: Sequence[Sequence], names: str) -> str:
    """A derived table."""
    cell = lambda x: number(x) if isinstance(x, float) else repr(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS {names}"


def tables(model: Model) -> str:
    """CTEs t_<name>(parents..., name, p)."""
    out = []
    for v in model.network.variables:
        names = [*(p.name for p in model.network.parents(v)), v.name]
        rows = [(*c, s, float(p)) for c, row in model.tables[v.id].items() for s, p in enumerate(row)]
        out.append(f"t_{v.name} AS (SELECT * FROM {values(rows, f'x({chr(44).join(names)}, p)')})")
    return ", ".join(out)


def joint(model: Model) -> str:
    """The CTE j(names..., p): every assignment with its probability."""
    net = model.network
    out, names = f"SELECT * FROM t_{net.topological()[0].name}", [net.topological()[0].name]
    for v in net.topological()[1:]:
        on = " AND ".join(f"a.{p.name} = b.{p.name}" for p in net.parents(v)) or "true"
        out = f"SELECT {', '.join(f'a.{n}' for n in names)}, b.{v.name}, a.p * b.p AS p FROM ({out}) a JOIN t_{v.name} b ON {on}"
        names.append(v.name)
    return f"{tables(model)}, j AS ({out})"


def posterior(model: Model, evidence: Mapping[str, int] | None = None, only: Sequence[str] | None = None, digits: int = 6) -> str:
    """(var_id, state, p) by enumeration."""
    where = " AND ".join(f"{k} = {s}" for k, s in (evidence or {}).items()) or "true"
    parts = []
    for v in model.network.variables:
        if only is None or v.name in only:
            parts.append(f"SELECT {v.id} AS var_id, d.s AS state, round(coalesce(sum(p), 0e0) / (SELECT sum(p) FROM e), {digits}) + 0e0 AS p FROM (SELECT CAST(range AS INTEGER) AS s FROM range({v.card})) d LEFT JOIN e ON e.{v.name} = d.s GROUP BY d.s")
    return f"WITH {joint(model)}, e AS (SELECT * FROM j WHERE {where}) " + " UNION ALL ".join(parts)


def cells(network: Network, variable: str) -> str:
    """(config, parents..., state) of a table, from the declared domains."""
    parents = network.parents(variable)
    v = network[variable]
    steps = strides(p.card for p in parents)
    config = " + ".join(f"CAST({p.name} AS BIGINT) * {s}" for p, s in zip(parents, steps)) or "CAST(0 AS BIGINT)"
    domains = [f"(SELECT CAST(range AS INTEGER) AS {x.name} FROM range({x.card})) d_{x.name}" for x in (*parents, v)]
    names = "".join(f"{p.name}, " for p in parents)
    return f"SELECT {config} AS config, {names}{variable} AS state FROM " + ", ".join(domains)


def config(network: Network, variable: str) -> str:
    parents = network.parents(variable)
    return " + ".join(f"CAST({p.name} AS BIGINT) * {s}" for p, s in zip(parents, strides(p.card for p in parents))) or "CAST(0 AS BIGINT)"


def fitted(network: Network, source: str, unseen: str = "uniform") -> str:
    """CTE cpt(var_id, config, state, p) from the CTE or table `source` of codes."""
    parts = []
    for v in network.variables:
        none = f"1e0 / {v.card}" if unseen == "uniform" else "0e0"
        parts.append(
            f"SELECT {v.id} AS var_id, g.config, g.state, CASE WHEN sum(coalesce(c.n, 0)) OVER (PARTITION BY g.config) = 0 THEN {none} ELSE coalesce(c.n, 0) / CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.config) AS DOUBLE) END AS p "
            f"FROM ({cells(network, v.name)}) g LEFT JOIN (SELECT {config(network, v.name)} AS config, {v.name} AS state, count(*) AS n FROM {source} GROUP BY ALL) c ON g.config = c.config AND g.state = c.state"
        )
    return "cpt AS (" + " UNION ALL ".join(parts) + ")"


def local_cost(target: str, parents: Sequence[str], source: str = "m") -> str:
    """A scalar query: minus the log-likelihood of a family."""
    ps = ", ".join(parents)
    if not parents:
        return f"(SELECT t.m * log2(t.m) - x.a FROM (SELECT CAST(count(*) AS DOUBLE) AS m FROM {source}) t, (SELECT sum(n * log2(n)) AS a FROM (SELECT count(*) AS n FROM {source} GROUP BY {target})) x)"
    return f"(SELECT t.a - x.a FROM (SELECT sum(n * log2(n)) AS a FROM (SELECT count(*) AS n FROM {source} GROUP BY {ps})) t, (SELECT sum(n * log2(n)) AS a FROM (SELECT count(*) AS n FROM {source} GROUP BY {ps}, {target})) x)"


def free(target: str, parents: Sequence[str], cards: Mapping[str, int]) -> int:
    out = cards[target] - 1
    for p in parents:
        out *= cards[p]
    return out


def local_mdl(target: str, parents: Sequence[str], cards: Mapping[str, int], source: str = "m") -> str:
    return f"({local_cost(target, parents, source)} + {free(target, parents, cards)} * log2((SELECT count(*) FROM {source})) / 2)"


def all_local(names: Sequence[str], cards: Mapping[str, int], most: int) -> str:
    """CTE local(target, parents, cost): parents as sorted names joined by commas."""
    parts = []
    for t in names:
        rest = sorted(n for n in names if n != t)
        for k in range(most + 1):
            for ps in combinations(rest, k):
                parts.append(f"SELECT '{t}' AS target, '{','.join(ps)}' AS parents, {local_mdl(t, ps, cards)} AS cost")
    return "local AS (" + " UNION ALL ".join(parts) + ")"


def dags(names: Sequence[str], forest: bool = False) -> list[dict[str, tuple[str, ...]]]:
    """All directed acyclic graphs over a few names as parent sets; forest: each has at most one edge to a later one."""
    pairs = list(combinations(names, 2))
    out = []
    for kinds in configurations([3] * len(pairs)):
        if forest and any(sum(k > 0 for (a, _), k in zip(pairs, kinds) if a == n) > 1 for n in names):
            continue
        parents: dict[str, list[str]] = {n: [] for n in names}
        for (a, b), k in zip(pairs, kinds):
            if k:
                parents[b if k == 1 else a].append(a if k == 1 else b)
        left, done = set(names), set()
        while ready := {n for n in left if set(parents[n]) <= done}:
            done |= ready
            left -= ready
        if not left:
            out.append({n: tuple(sorted(p)) for n, p in parents.items()})
    return out


def best_of(graphs: list[dict[str, tuple[str, ...]]], names: Sequence[str], cards: Mapping[str, int], source: str) -> str:
    rows = [(i, t, ",".join(ps)) for i, g in enumerate(graphs) for t, ps in g.items()]
    return f"WITH m AS ({source}), {all_local(names, cards, len(names) - 1)} SELECT round(min(cost), 6) AS score FROM (SELECT g, sum(l.cost) AS cost FROM {values(rows, 'd(g, target, parents)')} JOIN local l ON d.target = l.target AND d.parents = l.parents GROUP BY g)"


def best_by_sets(names: Sequence[str], cards: Mapping[str, int], source: str) -> str:
    """CTE best(cost): the least sum of local costs over all directed acyclic graphs, by sets: every set has a member whose parents are in the rest. Needs the CTE m."""
    bit = {n: 1 << i for i, n in enumerate(names)}
    parts = []
    for t in names:
        rest = [n for n in names if n != t]
        parts += [f"SELECT {bit[t]} AS t, {sum(bit[p] for p in ps)} AS ps, {local_mdl(t, ps, cards, source)} AS cost" for k in range(len(names)) for ps in combinations(rest, k)]
    out = [f"families AS ({' UNION ALL '.join(parts)})", f"pools AS (SELECT f.t, r.range AS pool, min(cost) AS cost FROM families f, range({1 << len(names)}) r WHERE (f.ps & r.range) = f.ps AND (r.range & f.t) = 0 GROUP BY ALL)", "c0 AS (SELECT CAST(0 AS BIGINT) AS s, 0e0 AS cost)"]
    out += [f"c{k} AS (SELECT c.s | p.t AS s, min(c.cost + p.cost) AS cost FROM c{k - 1} c JOIN pools p ON p.pool = c.s GROUP BY ALL)" for k in range(1, len(names) + 1)]
    return ", ".join(out) + f", best AS (SELECT cost FROM c{len(names)})"


def in_steps(steps: Sequence[tuple[str, str]], names: Sequence[str], cards: Mapping[str, int], source: str) -> str:
    """(parent, child, score): edges parent -> child are offered in turn, as (child, parent); each is taken if it closes no cycle and lowers the child's cost."""
    states: list[frozenset[tuple[str, str]]] = [frozenset()]
    chain = ["s0 AS (SELECT 0 AS state)"]
    cost = lambda child, edges: f"(SELECT cost FROM local WHERE target = '{child}' AND parents = '{','.join(sorted(p for p, c in edges if c == child))}')"

    def leads(a: str, b: str, edges: frozenset) -> bool:
        return a == b or any(leads(c, b, edges) for p, c in edges if p == a)

    for k, (child, parent) in enumerate(steps, 1):
        whens = []
        for old in list(states):
            new = old | {(parent, child)}
            if new != old and not leads(child, parent, old):
                if new not in states:
                    states.append(new)
                whens.append(f"WHEN {states.index(old)} THEN CASE WHEN {cost(child, new)} < {cost(child, old)} THEN {states.index(new)} ELSE {states.index(old)} END")
        chain.append(f"s{k} AS (SELECT {'CASE state ' + ' '.join(whens) + ' ELSE state END' if whens else 'state'} AS state FROM s{k - 1})")
    totals = " ".join(f"WHEN {i} THEN {' + '.join(cost(n, edges) for n in names)}" for i, edges in enumerate(states))
    listed = values([(i, p, c) for i, edges in enumerate(states) for p, c in sorted(edges)], "e(state, parent, child)")
    return f"WITH m AS ({source}), {all_local(names, cards, len(names) - 1)}, {', '.join(chain)} SELECT e.parent, e.child, round(CASE s.state {totals} END, 6) AS score FROM s{len(steps)} s LEFT JOIN {listed} ON e.state = s.state"


def sampled(model: Model, n: int, seed: int, evidence: Mapping[str, int] | None = None) -> str:
    """CTE s(i, names..., _w) of weighted samples."""
    net, evidence = model.network, dict(evidence or {})
    inner, names, weights = f"SELECT range AS i FROM range({n})", [], []
    for v in net.topological():
        parents = net.parents(v)
        at = " + ".join(f"{p.name} * {s}" for p, s in zip(parents, strides(p.card for p in parents))) or "0"
        rows = [model.tables[v.id][c] for c in configurations(p.card for p in parents)]
        if v.name in evidence:
            state = str(evidence[v.name])
            case = " ".join(f"WHEN {k} THEN {number(r[evidence[v.name]])}" for k, r in enumerate(rows))
            weights.append(f"(CASE {at} {case} END)")
        else:
            u = uniform_sql(seed, "i", v.name)
            draw = lambda r: "CASE " + " ".join(f"WHEN {u} < {number(sum(r[: s + 1]))} THEN {s}" for s in range(len(r) - 1)) + f" ELSE {len(r) - 1} END"
            state = f"CASE {at} " + " ".join(f"WHEN {k} THEN {draw(r)}" for k, r in enumerate(rows)) + " END"
        inner = f"SELECT *, CAST({state} AS INTEGER) AS {v.name} FROM ({inner})"
        names.append(v.name)
    return f"s AS (SELECT i, {', '.join(v.name for v in net.variables)}, {' * '.join(weights) or '1e0'} AS _w FROM ({inner}))"


def frequencies(model: Model, source: str, digits: int = 9) -> str:
    """(var_id, state, p): weighted shares in `source`, a table with the names and _w."""
    parts = [f"SELECT {v.id} AS var_id, d.s AS state, round(coalesce(sum(_w), 0e0) / (SELECT sum(_w) FROM {source}), {digits}) AS p FROM (SELECT CAST(range AS INTEGER) AS s FROM range({v.card})) d LEFT JOIN {source} x ON x.{v.name} = d.s GROUP BY d.s" for v in model.network.variables]
    return " UNION ALL ".join(parts)
