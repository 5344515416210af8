import math

import pytest

from credence import Network
from credence.network import NetworkError
from credence.operators import counts, cpt, discretize, info, learn, sampling, score
from credence.plans import catalog, sql
from credence.plans import models as m

#: Optimal MDL costs: (empty graph, best) of the models at the smallest size, with the skeletons.
GOLDEN = {"LI": (68827.30, 68827.30, set()), "CUST": (65069.34, 64810.02, {frozenset({"seg", "reg"}), frozenset({"reg", "ostat"})})}


def skeleton(network):
    return {frozenset((network[a].name, network[b].name)) for a, b in network.edges}


def cache(table, network):
    return score.ScoreCache(table.cache(), score.cards_of(network))


@pytest.fixture(scope="module")
def five(spark):
    names = [v.name for v in m.FIVE.network.variables]
    return cache(counts.compress(sampling.forward_samples(spark, m.FIVE, 20_000, seed=9), names), m.FIVE.network)


@pytest.mark.parametrize("name, model, rows", [("LI", m.LI, catalog._li), ("CUST", m.CUST, catalog._cust)])
def test_optimal_structures(spark, sf_dir, name, model, rows):
    if not sf_dir.endswith("sf0.001"):
        pytest.skip("the known optima are those of sf0.001")
    scores = cache(rows(spark, sf_dir), model.network())
    empty, best, edges = GOLDEN[name]
    assert scores.total(model.network()) == pytest.approx(empty, abs=0.01)
    found = learn.exhaustive(model.network(), scores)
    assert found.score == pytest.approx(best, abs=0.01) and skeleton(found.network) == edges


def test_exhaustive_against_enumeration(five):
    net = Network.of({f"V{i}": 2 for i in range(1, 5)})
    best = min(sum(five.local(t, ps) for t, ps in g.items()) for g in sql.dags([f"V{i}" for i in range(1, 5)]))
    assert learn.exhaustive(net, five).score == pytest.approx(best)
    restricted = learn.exhaustive(net, five, mode="restricted").score
    assert restricted == pytest.approx(min(sum(five.local(t, ps) for t, ps in g.items()) for g in sql.dags([f"V{i}" for i in range(1, 5)], forest=True)))
    assert restricted >= best - 1e-9


@pytest.mark.parametrize("n, all_, forest", [(3, 25, 15), (4, 543, 105)])
def test_search_space_sizes(n, all_, forest):
    names = [f"x{i}" for i in range(n)]
    assert len(sql.dags(names)) == all_ and len(sql.dags(names, forest=True)) == forest


def test_learners_improve_and_stay_acyclic(five):
    empty = m.FIVE.network.without_edges()
    start, best = five.total(empty), learn.exhaustive(empty, five).score
    found = [learn.greedy(empty, five, seed=1), learn.k2(empty, five, seed=1), learn.anneal(empty, five, 500.0, 0.5, 0.98, best_seen=True, seed=1), learn.greedy_with_hint(empty, five, ["V1"], ["V2", "V3"])]
    found += [learn.stepwise(empty, five, 2, inner, between, seed=1) for inner in learn.INNER for between in learn.BETWEEN]
    found += [learn.stepwise_hierarchical(empty, five, alpha, seed=1) for alpha in (0.0, 0.3, 1.0)]
    for x in found:
        assert best - 1e-6 <= x.score <= start + 1e-6
        assert x.score == pytest.approx(five.total(x.network)) and len(x.network.levels()) == 5


def test_seeds_repeat(five):
    empty = m.FIVE.network.without_edges()
    for f in (learn.greedy, learn.k2, learn.anneal, learn.stepwise, learn.stepwise_hierarchical):
        assert f(empty, five, seed=5) == f(empty, five, seed=5)


def test_hint_and_exclusions(five):
    empty = m.FIVE.network.without_edges()
    hinted = learn.exhaustive_with_hint(empty, five, ["V1", "V3"], ["V2"])
    assert {b for _, b in hinted.network.edges} <= {2}
    kept = learn.k2(empty, five, {f"V{i}": [f"V{j}" for j in range(1, 6)] for i in range(1, 6)})
    assert not kept.network.edges
    with pytest.raises(NetworkError):
        learn.exhaustive(empty, five, most=4)


def test_annealing_ends(five):
    one = Network.of({"V1": 2})
    assert learn.anneal(one, five).network == one
    assert learn.anneal(m.FIVE.network.without_edges(), five, acceptance="absolute", most_moves=500).score


def test_clusters():
    assert sorted(map(len, learn.initial_clusters("abcdefg", 3))) == [2, 2, 3]
    assert learn.prune_probability(0.5, 1.0, 2.0, 0.1, 0.2) == pytest.approx(0.5**0.5)
    assert learn.prune_probability(0.5, 1.0, 2.0, 0.5, None, 1.0) == pytest.approx(0.25)
    assert learn.prune_probability(0.5, 1.0, 2.0, None, None) is None


def test_unseen_parent_states(spark):
    table = counts.compress(spark.createDataFrame([(0, 0), (0, 2), (0, 2)], "p int, x int"), ["p", "x"])
    net = Network.of({"p": 2, "x": 3}, [("p", "x")])
    assert cpt.fit_model(table, net).row("x", (1,)) == pytest.approx((1 / 3,) * 3)
    assert cpt.fit_model(table, net, "zero").row("x", (1,)) == (0, 0, 0)
    assert cpt.fit_model(table, net).row("x", (0,)) == pytest.approx((1 / 3, 0, 2 / 3))
    with pytest.raises(NetworkError, match="no samples"):
        cpt.fit_model(table.limit(0), net)


def test_scores_by_hand(spark):
    table = counts.compress(spark.createDataFrame([(0, 0)] * 3 + [(1, 1)] * 5, "a int, b int"), ["a", "b"])
    net = Network.of({"a": 2, "b": 2}, [("a", "b")])
    cost = -(3 * math.log2(3 / 8) + 5 * math.log2(5 / 8))
    assert score.log_likelihood_cost(table, net) == pytest.approx(cost)
    assert score.log_likelihood_cost(table, net, ["b"]) == pytest.approx(0)
    assert score.aic(table, net) == pytest.approx(cost + 3) and score.mdl(table, net) == pytest.approx(cost + 3 * math.log2(8) / 2)
    with pytest.raises(NetworkError):
        score.mdl(table.limit(0), net)
    mi = info.mi_matrix(table, ["a", "b"], {"a": 2, "b": 2}).first()
    assert mi.mi == pytest.approx(cost / 8)


def test_grouping_sets_agree(spark, sf_dir):
    table = catalog._li(spark, sf_dir).cache()
    by_family = sorted(r.n for r in counts.family_counts(table, catalog.LI_FAMILIES, m.LI.cards).collect())
    assert by_family == sorted(r.n for r in counts.grouping_set_counts(table, catalog.LI_FAMILIES, list(m.LI.cards)).collect())


def test_codes_are_checked(spark):
    df = spark.createDataFrame([(0,), (None,), (3,)], "x int")
    with pytest.raises(Exception, match="is not in 0..2"):
        discretize.checked(df, {"x": 3}).collect()
    assert discretize.complete(df, ["x"]).count() == 2
