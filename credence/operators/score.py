"""Scores of structures, all costs: smaller is better. Logarithms are base 2."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..network import Network, NetworkError
from .counts import Family, family_counts, sampling_size

#: Cost of one free parameter, given the number of samples.
Penalty = Callable[[int], float]
#: A decomposable score: (family, cost) of families from their counts (family, config, state, n), given the families, the numbers of states and the number of samples.
LocalScore = Callable[[DataFrame, Sequence[Family], dict[str, int], int], DataFrame]
#: Lanczos' approximation of the gamma function for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def aic_penalty(samples: int) -> float:
    return 1.0


def mdl_penalty(samples: int) -> float:
    if samples <= 0:
        raise NetworkError("there are no samples")
    return math.log2(samples) / 2


def parameters(family: Family, cards: dict[str, int]) -> int:
    """Free parameters of one table."""
    return (cards[family.target] - 1) * math.prod(cards[p] for p in family.parents)


def network_families(network: Network) -> list[Family]:
    return [Family(v.name, tuple(p.name for p in network.parents(v))) for v in network.variables]


def cards_of(network: Network) -> dict[str, int]:
    return {v.name: v.card for v in network.variables}


def network_parameters(network: Network) -> int:
    return sum(parameters(f, cards_of(network)) for f in network_families(network))


def family_costs(table: DataFrame, families: Sequence[Family], cards: dict[str, int]) -> DataFrame:
    """(family, cost): minus the log-likelihood of each family, in one job."""
    return _likelihood(family_counts(table, families, cards))


def _likelihood(counts: DataFrame) -> DataFrame:
    per_config = counts.groupBy("family", "config").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("inner"))
    return per_config.groupBy("family").agg((F.sum(F.col("m") * F.log2(F.col("m").cast("double"))) - F.sum("inner")).alias("cost"))


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function, for x > 0."""
    series = sum((F.lit(c) / (x + (i - 1)) for i, c in enumerate(_LANCZOS[1:], 1)), F.lit(_LANCZOS[0]))
    return math.log(2 * math.pi) / 2 + (x - 0.5) * F.log(x + 6.5) - (x + 6.5) + F.log(series)


def penalised(penalty: Penalty) -> LocalScore:
    """Minus the log-likelihood, and a price for each free parameter: AIC, MDL."""

    def of(counts: DataFrame, families: Sequence[Family], cards: dict[str, int], samples: int) -> DataFrame:
        per_parameter = penalty(samples)
        prices = F.array(*[F.lit(float(per_parameter * parameters(f, cards))) for f in families])
        return _likelihood(counts).select("family", (F.col("cost") + F.get(prices, F.col("family"))).alias("cost"))

    return of


def _marginal(prior: Callable[[int, int], float]) -> LocalScore:
    """Minus the logarithm of the marginal likelihood under Dirichlet priors whose every cell has prior(configurations, states). Configurations that were not seen add nothing."""

    def of(counts: DataFrame, families: Sequence[Family], cards: dict[str, int], samples: int) -> DataFrame:
        cell = [float(prior(math.prod(cards[p] for p in f.parents), cards[f.target])) for f in families]
        a = F.get(F.array(*map(F.lit, cell)), F.col("family"))
        row = F.get(F.array(*[F.lit(c * cards[f.target]) for c, f in zip(cell, families)]), F.col("family"))
        rows = counts.groupBy("family", "config").agg(F.sum("n").alias("m"), F.sum(lgamma(F.col("n") + a) - lgamma(a)).alias("inner"))
        return rows.groupBy("family").agg((F.sum(lgamma(F.col("m") + row) - lgamma(row) - F.col("inner")) / math.log(2)).alias("cost"))

    return of


def bdeu(equivalent: float = 1.0) -> LocalScore:
    """The score of equivalent structures is equal; `equivalent` prior samples are spread over each table."""
    return _marginal(lambda configurations, states: equivalent / (configurations * states))


def k2_prior() -> LocalScore:
    """Every cell was seen once before."""
    return _marginal(lambda configurations, states: 1.0)


class ScoreCache:
    """Local scores of families, computed for many at a time and kept on the driver. `local` is any decomposable score; without it minus the log-likelihood with `penalty`."""

    def __init__(self, table: DataFrame, cards: dict[str, int], penalty: Penalty = mdl_penalty, batch: int = 512, local: LocalScore | None = None):
        self.table, self.cards, self.batch = table, cards, batch
        self.samples = sampling_size(table)
        self.score = local or penalised(penalty)
        self._known: dict[tuple[str, frozenset[str]], float] = {}
        self.jobs = 0

    def load(self, families: Iterable[Family]) -> None:
        missing = {(f.target, frozenset(f.parents)) for f in families} - self._known.keys()
        wanted = [Family(t, tuple(sorted(p))) for t, p in sorted(missing, key=lambda x: (x[0], sorted(x[1])))]
        for at in range(0, len(wanted), self.batch):
            part = wanted[at : at + self.batch]
            self.jobs += 1
            counted = family_counts(self.table, part, self.cards)
            for r in self.score(counted, part, self.cards, self.samples).collect():
                f = part[r.family]
                self._known[f.target, frozenset(f.parents)] = r.cost

    def local(self, target: str, parents: Iterable[str] = ()) -> float:
        key = (target, frozenset(parents))
        if key not in self._known:
            self.load([Family(target, tuple(parents))])
        return self._known[key]

    def total(self, network: Network) -> float:
        families = network_families(network)
        self.load(families)
        return sum(self.local(f.target, f.parents) for f in families)


def log_likelihood_cost(table: DataFrame, network: Network, only: Sequence[str] | None = None) -> float:
    """Minus the log-likelihood, over all variables or the families of some."""
    families = [f for f in network_families(network) if only is None or f.target in only]
    return sum(r.cost for r in family_costs(table, families, cards_of(network)).collect())


def aic(table: DataFrame, network: Network, only: Sequence[str] | None = None) -> float:
    """The parameters are always those of the whole network."""
    return log_likelihood_cost(table, network, only) + network_parameters(network)


def mdl(table: DataFrame, network: Network, only: Sequence[str] | None = None) -> float:
    penalty = mdl_penalty(sampling_size(table))
    return log_likelihood_cost(table, network, only) + penalty * network_parameters(network)
