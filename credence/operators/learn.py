"""Structure search. Every learner minimises a decomposable score, gets local scores from a `ScoreCache` many at a time, and searches on the driver; it returns a structure only, whose tables are fitted afterwards.

`variables` restricts a search to some of the network's variables; edges that are there already are kept unless a learner says otherwise. Random choices come from `seed`.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations
from typing import Literal

from ..network import Network, NetworkError
from .counts import Family
from .info import mi_matrix
from .score import ScoreCache

Names = Sequence[str] | None


@dataclass(frozen=True)
class Learned:
    network: Network
    score: float


def _names(network: Network, variables: Names) -> list[str]:
    return list(variables) if variables is not None else [v.name for v in network.variables]


def _parent_names(network: Network, name: str) -> frozenset[str]:
    return frozenset(p.name for p in network.parents(name))


def exhaustive(network: Network, scores: ScoreCache, variables: Names = None, mode: Literal["exhaustive", "restricted"] = "exhaustive", most: int = 12) -> Learned:
    """The best structure over the variables, beside the edges that are there.

    exhaustive: the true optimum, by dynamic programming over sets of variables (every set has a best sink). n variables take n 2^(n-1) local scores and as many steps, so `most` limits n (12 variables are 24,576 scores in 48 jobs; 16 are half a million). restricted: only structures in which each variable has at most one new edge, in either direction, to a later one.
    """
    names = _names(network, variables)
    return _optimal(network, scores, names, most) if mode == "exhaustive" else _restricted(network, scores, names)


def _optimal(network: Network, scores: ScoreCache, names: list[str], most: int) -> Learned:
    if len(names) > most:
        raise NetworkError(f"{len(names)} variables: an exhaustive search takes at most {most}")
    fixed = {n: _parent_names(network, n) for n in names}
    inside = {n: fixed[n] & set(names) for n in names}
    subsets = lambda pool: (frozenset(c) for k in range(len(pool) + 1) for c in combinations(sorted(pool), k))
    scores.load(Family(n, tuple(s | fixed[n])) for n in names for s in subsets(set(names) - {n}))
    if any(not fixed[n] <= set(names) for n in names):  # paths may run outside: only adding edges one by one is safe then
        raise NetworkError("variables outside the search have edges into it")
    # The best parents in a pool are the whole pool or the best in a pool of one less; pools come by size.
    best_parents: dict[tuple[str, frozenset[str]], frozenset[str]] = {}
    for n in names:
        rank = lambda s: (scores.local(n, s), len(s), sorted(s))  # noqa: B023, E731
        for pool in subsets(set(names) - {n}):
            if inside[n] <= pool:
                best_parents[n, pool] = min((pool, *(best_parents[n, pool - {x}] for x in pool - inside[n])), key=rank)
    cost: dict[frozenset[str], tuple[float, str | None]] = {frozenset(): (0.0, None)}
    for chosen in subsets(set(names)):
        options = [(cost[rest][0] + scores.local(n, best_parents[n, rest]), n) for n in sorted(chosen) if (rest := chosen - {n}) in cost and (n, rest) in best_parents]
        if options:
            cost[chosen] = min(options)
    left, picked = frozenset(names), []
    while left:
        n = cost[left][1]
        left = left - {n}
        picked.append((n, best_parents[n, left]))
    out = network
    for n, ps in reversed(picked):
        for p in sorted(ps - fixed[n], key=names.index):
            out = out.require_edge(p, n)
    return Learned(out, scores.total(out))


def _restricted(network: Network, scores: ScoreCache, names: list[str]) -> Learned:
    best = Learned(network, scores.total(network))
    pending = [(network, 0)]
    while pending:
        now, at = pending.pop()
        if at >= len(names) - 1:
            total = scores.total(now)
            if total < best.score:
                best = Learned(now, total)
            continue
        pending.append((now, at + 1))
        for later in names[at + 1 :]:
            for a, b in ((names[at], later), (later, names[at])):
                if (new := now.with_edge(a, b)) is not None:
                    pending.append((new, at + 1))
    return best


def exhaustive_with_hint(network: Network, scores: ScoreCache, parents: Sequence[str], children: Sequence[str], most: int = 16) -> Learned:
    """The best set of edges from parents to children on top of those there; sets that would close a cycle are left out.

    Where no child leads to a parent no set can, and each child's parents are searched apart: 2^parents scores a child, for at most `most` parents. Else all sets of edges are tried, of at most `most` edges.
    """
    if not any(network.reaches(c, p) for c in children for p in parents):
        return _best_parents(network, scores, parents, children, most)
    pairs = [(p, c) for c in children for p in parents if p != c]
    if len(pairs) > most:
        raise NetworkError(f"{len(pairs)} possible edges: at most {most} are searched")
    scores.load(Family(c, tuple(_parent_names(network, c) | set(s))) for c in children for k in range(len(parents) + 1) for s in combinations([p for p in parents if p != c], k))
    best = Learned(network, scores.total(network))
    found: list[tuple[Network, int]] = [(network, 0)]
    while found:
        now, at = found.pop()
        if at == len(pairs):
            total = scores.total(now)
            if total < best.score:
                best = Learned(now, total)
            continue
        found.append((now, at + 1))
        if (new := now.with_edge(*pairs[at])) is not None:
            found.append((new, at + 1))
    return best


def _best_parents(network: Network, scores: ScoreCache, parents: Sequence[str], children: Sequence[str], most: int) -> Learned:
    if len(parents) > most:
        raise NetworkError(f"{len(parents)} possible parents: all sets of at most {most} are searched")
    sets = [frozenset(s) for k in range(len(parents) + 1) for s in combinations(parents, k)]
    scores.load(Family(c, tuple(_parent_names(network, c) | s)) for c in children for s in sets)
    for c in children:
        own = _parent_names(network, c)
        best = min(sets, key=lambda s: (scores.local(c, own | s), len(own | s), sorted(s)))
        for p in sorted(best - own, key=list(parents).index):
            network = network.require_edge(p, c)
    return Learned(network, scores.total(network))


def _try_parents(network: Network, scores: ScoreCache, child: str, candidates: Iterable[str], on_kept: Callable[[str], None] = lambda p: None) -> Network:
    """Adds each candidate, in turn, that lowers the child's local score. A step's families with one candidate more are scored together."""
    left = list(candidates)
    while left:
        own = _parent_names(network, child)
        scores.load(Family(child, tuple(own | {p})) for p in left)
        while left:
            p = left.pop(0)
            new = network.with_edge(p, child)
            if new is not None and scores.local(child, own | {p}) < scores.local(child, own):
                network = new
                on_kept(p)
                break
    return network


def greedy(network: Network, scores: ScoreCache, variables: Names = None, seed: int | None = 0) -> Learned:
    """One pass: each variable in random order is a child, the later ones in a new random order its candidate parents. seed None keeps the given order."""
    rng = random.Random(seed) if seed is not None else None
    names = _names(network, variables)
    if rng:
        rng.shuffle(names)
    for i, child in enumerate(names):
        later = names[i + 1 :]
        if rng:
            rng.shuffle(later)
        network = _try_parents(network, scores, child, later)
    return Learned(network, scores.total(network))


def greedy_with_hint(network: Network, scores: ScoreCache, parents: Sequence[str], children: Sequence[str], seed: int | None = 0) -> Learned:
    """The same with given children and candidate parents."""
    rng = random.Random(seed) if seed is not None else None
    children = list(children)
    if rng:
        rng.shuffle(children)
    for child in children:
        candidates = [p for p in parents if p != child]
        if rng:
            rng.shuffle(candidates)
        network = _try_parents(network, scores, child, candidates)
    return Learned(network, scores.total(network))


def k2(network: Network, scores: ScoreCache, excluded: Mapping[str, Iterable[str]] | None = None, variables: Names = None, seed: int | None = 0) -> Learned:
    """Targets in random order; candidates are all others but the excluded ones, in list order. A target that took a parent is excluded as a parent of it. seed None keeps the order of the targets."""
    names = _names(network, variables)
    banned = {n: set((excluded or {}).get(n, ())) for n in names}
    targets = list(names)
    if seed is not None:
        random.Random(seed).shuffle(targets)
    for target in targets:
        candidates = [n for n in names if n != target and n not in banned[target]]
        network = _try_parents(network, scores, target, candidates, lambda p, t=target: banned[p].add(t))
    return Learned(network, scores.total(network))


def anneal(network: Network, scores: ScoreCache, initial: float = 100.0, final: float = 0.1, rate: float = 0.95, boltzmann: float = 1.0, unchanged_most: int = 100, variables: Names = None, seed: int = 0, acceptance: Literal["difference", "absolute"] = "difference", most_moves: int = 100_000, best_seen: bool = False) -> Learned:
    """Simulated annealing over adding, deleting and reversing an edge.

    A worse structure is accepted with probability exp(-d / (boltzmann T)), where d is the rise of the score ("difference") or the new score itself ("absolute"). Returns the last structure, or the best one seen.
    """
    rng = random.Random(seed)
    names = _names(network, variables)
    now = best = Learned(network, scores.total(network))
    heat, unchanged = initial, 0
    if len(names) < 2:
        return now
    for _ in range(most_moves):
        if heat <= final or unchanged >= unchanged_most:
            break
        kind = rng.randrange(3)
        edges = [(now.network[a].name, now.network[b].name) for a, b in now.network.edges if now.network[a].name in names and now.network[b].name in names]
        new = now.network.with_edge(*rng.sample(names, 2)) if kind == 0 else (now.network.without_edge if kind == 1 else now.network.with_reversed)(*rng.choice(edges)) if edges else None
        if new is None:
            continue
        total = scores.total(new)
        rise = total - now.score
        exponent = -(rise if acceptance == "difference" else total) / (boltzmann * heat)
        if rise <= 0 or rng.random() < math.exp(min(0.0, exponent)):
            now, unchanged = Learned(new, total), 0
            best = min(best, now, key=lambda x: x.score)
        else:
            unchanged += 1
        heat *= rate
    return best if best_seen else now


#: Inner learners of `stepwise`, by name; all take (network, scores, variables=, seed=).
INNER: dict[str, Callable[..., Learned]] = {
    "exhaustive": lambda network, scores, variables, seed: exhaustive(network, scores, variables),
    "greedy": greedy,
    "k2": lambda network, scores, variables, seed: k2(network, scores, None, variables, seed),
    "anneal": lambda network, scores, variables, seed: anneal(network, scores, variables=variables, seed=seed, best_seen=True),
}
#: Learners between clusters; all take (network, scores, parents, children).
BETWEEN: dict[str, Callable[..., Learned]] = {"exhaustive": exhaustive_with_hint, "greedy": greedy_with_hint}


def initial_clusters(names: Sequence[str], size: int, seed: int = 0) -> list[list[str]]:
    """ceil(n / size) clusters, dealt round robin after a shuffle."""
    names = list(names)
    random.Random(seed).shuffle(names)
    count = -(-len(names) // size)
    return [names[i::count] for i in range(count)]


def stepwise(network: Network, scores: ScoreCache, cluster_size: int = 3, inner: str = "greedy", between: str = "greedy", variables: Names = None, seed: int = 0) -> Learned:
    """Learns inside random clusters, then merges random pairs of clusters, with edges from the one to the other, until one is left. Starts without edges."""
    rng = random.Random(seed)
    network = network.without_edges()
    clusters = initial_clusters(_names(network, variables), cluster_size, seed)
    for own in clusters:
        network = INNER[inner](network, scores, variables=own, seed=rng.randrange(1 << 30)).network
    while len(clusters) > 1:
        parent, child = rng.sample(range(len(clusters)), 2)
        network = BETWEEN[between](network, scores, clusters[parent], clusters[child]).network
        merged = clusters[parent] + clusters[child]
        clusters = [c for i, c in enumerate(clusters) if i not in (parent, child)] + [merged]
    return Learned(network, scores.total(network))


def prune_probability(alpha: float, new: float, average: float, left: float | None, right: float | None, merged: float | None = None) -> float | None:
    """Chance that a link to a merged cluster is dropped. left and right: the old links to the two parts, None where there is none.

    Both: alpha ^ (new / average). One: alpha ^ (similarity of the merged parts / that link). None: there is no link, and the answer is None.
    """
    if left is None and right is None:
        return None
    if left is not None and right is not None:
        return alpha ** (new / average) if average > 0 else 1.0
    link = left if left is not None else right
    return alpha ** ((merged or 0.0) / link) if link > 0 else 1.0


def stepwise_hierarchical(network: Network, scores: ScoreCache, alpha: float = 0.5, between: str = "greedy", variables: Names = None, seed: int = 0) -> Learned:
    """Merges the clusters with the largest mean mutual information, in a direction chosen by coin, and drops links at random; ends when one cluster or no link is left. The mutual information of all pairs comes from one job."""
    rng = random.Random(seed)
    network = network.without_edges()
    names = _names(network, variables)
    mi = {frozenset((r.a, r.b)): r.mi for r in mi_matrix(scores.table, names, scores.cards).collect()}
    clusters = [(n,) for n in names]
    links = {frozenset(((a,), (b,))): mi[frozenset((a, b))] for a, b in combinations(names, 2)}
    average = sum(links.values()) / len(links) if links else 0.0
    while len(clusters) > 1 and links:
        pair = max(links, key=lambda p: (links[p], sorted(p)))
        strength = links.pop(pair)
        parent, child = sorted(pair)
        if rng.random() < 0.5:
            parent, child = child, parent
        network = BETWEEN[between](network, scores, parent, child).network
        merged = parent + child
        clusters = [c for c in clusters if c not in pair]
        for other in clusters:
            left, right = (links.pop(frozenset((part, other)), None) for part in (parent, child))
            new = sum(mi[frozenset((a, b))] for a in merged for b in other) / (len(merged) * len(other))
            chance = prune_probability(alpha, new, average, left, right, strength)
            if chance is not None and rng.random() >= chance:
                links[frozenset((merged, other))] = new
        clusters.append(merged)
    return Learned(network, scores.total(network))
