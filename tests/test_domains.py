"""Codes outside their domains, long chains, scores plugged in."""

import math

import pytest
from pyspark.sql import functions as F

from credence import Network
from credence.network import NetworkError
from credence.operators import counts, cpt, graph, info, learn, score


@pytest.fixture
def strays(spark):
    rows = [(0, 0, 0)] * 5 + [(1, 0, 1)] * 3
    return lambda *more: counts.compress(spark.createDataFrame([*rows, *more], "a int, b int, x int"), ["a", "b", "x"])


CARDS = {"a": 2, "b": 2, "x": 2}


@pytest.mark.parametrize("stray", [(0, 2, 1), (0, 0, 2), (0, -1, 0), (0, None, 0), (0, 0, None)])
def test_a_code_outside_its_domain_raises(strays, stray):
    net = Network.of(CARDS, [("a", "x"), ("b", "x")])
    table = strays(*[stray] * 7)
    for read in (lambda: cpt.fit_model(table, net), lambda: info.entropies(table, [["a", "b", "x"]], CARDS).collect(), lambda: score.mdl(table, net), lambda: counts.family_counts(table, [counts.Family("x", ("a", "b"))], CARDS).collect()):
        with pytest.raises(Exception, match="is not in 0..1"):
            read()
    model = cpt.fit_model(strays(), net)
    assert model.row("x", (1, 0)) == (0.0, 1.0) and model.row("x", (0, 0)) == (1.0, 0.0) and model.row("x", (0, 1)) == (0.5, 0.5)


def test_levels_of_a_long_chain(spark):
    n = 200
    variables, edges = spark.range(n).select(F.col("id").cast("int").alias("var_id")), spark.range(n - 1).selectExpr("cast(id as int) as src", "cast(id + 1 as int) as dst")
    assert {r.var_id: r.level for r in graph.levels(variables, edges).collect()} == {i: i for i in range(n)}
    assert graph.reach(variables, edges).count() == n * (n + 1) // 2
    with pytest.raises(NetworkError):
        graph.levels(variables.filter("var_id < 5"), edges.filter("src < 4").union(spark.createDataFrame([(4, 0)], "src int, dst int")))
    assert {r.level for r in graph.levels(variables, edges.limit(0)).collect()} == {0}


def test_scores_plugged_in(spark):
    import random

    rng = random.Random(1)
    rows = [(a := rng.randrange(2), b := (a + (rng.random() < 0.2)) % 2, rng.randrange(3)) for _ in range(300)]
    cards = {"a": 2, "b": 2, "c": 3}
    table = counts.compress(spark.createDataFrame(rows, "a int, b int, c int"), list(cards))
    both = {(a, b): sum(r[:2] == (a, b) for r in rows) for a in (0, 1) for b in (0, 1)}
    total = 0.0
    for a in (0, 1):
        total += math.lgamma(2 + both[a, 0] + both[a, 1]) - math.lgamma(2) - sum(math.lgamma(1 + both[a, b]) for b in (0, 1))
    k2 = score.ScoreCache(table, cards, local=score.k2_prior())
    assert k2.local("b", ["a"]) == pytest.approx(total / math.log(2))
    bdeu = score.ScoreCache(table, cards, local=score.bdeu(2.0))
    assert bdeu.local("b", ["a"]) + bdeu.local("a") == pytest.approx(bdeu.local("a", ["b"]) + bdeu.local("b"))
    for scores in (k2, bdeu):
        assert {frozenset(e) for e in learn.exhaustive(Network.of(cards), scores).network.edges} == {frozenset((0, 1))}
    likelihood = score.ScoreCache(table, cards, local=lambda counted, families, cards, samples: score.penalised(lambda n: 0.0)(counted, families, cards, samples))
    assert likelihood.local("b", ["a"]) < score.ScoreCache(table, cards).local("b", ["a"])


def test_log_gamma(spark):
    xs = [1e-3, 0.02, 0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 12345.5, 1e9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(score.lgamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-12)


def test_parents_apart_and_together(spark):
    """Where no cycle can arise each child is searched apart; the answer is that of trying all sets of edges, and many edges are no obstacle."""
    import random

    rng = random.Random(2)
    cards = {f"v{i}": 2 for i in range(6)}
    rows = []
    for _ in range(400):
        r = [rng.randrange(2) for _ in range(3)]
        rows.append((*r, (r[0] + r[1] + (rng.random() < 0.1)) % 2, (r[2] + (rng.random() < 0.3)) % 2, rng.randrange(2)))
    scores = score.ScoreCache(counts.compress(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cards)), list(cards)), cards)
    empty = Network.of(cards)
    found = learn.exhaustive_with_hint(empty, scores, ["v0", "v1", "v2"], ["v3", "v4", "v5"])
    apart = learn._best_parents(empty, scores, ["v0", "v1", "v2"], ["v3", "v4", "v5"], 16)
    assert found == apart and {(0, 3), (1, 3), (2, 4)} <= set(found.network.edges)
    cyclic = learn.exhaustive_with_hint(empty.require_edge("v3", "v0"), scores, ["v0", "v1"], ["v3", "v4"])
    assert (0, 3) not in cyclic.network.edges
    assert learn.stepwise(empty, scores, 3, "exhaustive", "exhaustive", seed=1).score <= scores.total(empty)
