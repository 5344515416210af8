import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from credence import Model, Network
from credence.network import NetworkError, configurations
from credence.operators import bp, exact, sampling
from credence.operators.bp import Propagation
from credence.plans.models import CHAIN, FIVE, PEARL, SYM

GOLDEN = [
    (PEARL, {}, {"R": (0.2, 0.8), "S": (0.1, 0.9), "W": (0.36, 0.64), "H": (0.272, 0.728)}),
    (PEARL, {"H": 0}, {"R": (0.735294, 0.264706), "S": (0.338235, 0.661765), "W": (0.788235, 0.211765), "H": (1, 0)}),
    (CHAIN, {"B": 2, "D": 0}, {"C": (0.571429, 0.428571)}),
    (CHAIN, {"C": 1}, {"B": (0.330579, 0.173554, 0.495868)}),
    (CHAIN, {"A": 1, "C": 1}, {"B": (0.3125, 0.1875, 0.5)}),
    (CHAIN, {"D": 2}, {"A": (0.299285, 0.600954, 0.099762)}),
    (CHAIN, {"A": 0}, {"B": (0.2, 0.3, 0.5)}),
    (FIVE, {"V4": 1, "V1": 0}, {"V2": (0.64, 0.36), "V3": (0.7, 0.3), "V5": (0.202, 0.798)}),
]
LOOPY = {"V1": (0.338468, 0.661532), "V2": (0.243450, 0.756550), "V3": (0.414483, 0.585517), "V4": (0.221725, 0.778275)}
EXACT = {"V1": (0.333333, 0.666667), "V2": (0.235294, 0.764706), "V3": (0.411765, 0.588235), "V4": (0.217647, 0.782353)}


def read(df, model):
    out = {v.name: [None] * v.card for v in model.network.variables}
    for r in df.collect():
        out[model.network[r.var_id].name][r.state] = r.p
    return out


def close(got, want, tolerance=1e-6):
    for k, p in want.items():
        assert got[k] == pytest.approx(p, abs=tolerance), k


@pytest.mark.parametrize("model, evidence, want", GOLDEN)
def test_exact_and_propagation(spark, model, evidence, want):
    close(read(exact.posteriors(spark, model, evidence), model), want)
    close(read(bp.beliefs(spark, model, evidence, 1e-12), model), want)


def test_relational_propagation(spark):
    close(read(bp.relational(spark, PEARL, {"H": 0}), PEARL), GOLDEN[1][2])


def test_loop_tells_exact_from_loopy(spark):
    close(read(exact.posteriors(spark, FIVE, {"V5": 0}), FIVE), EXACT)
    close(read(bp.beliefs(spark, FIVE, {"V5": 0}, 1e-12), FIVE), LOOPY)
    close(read(exact.posteriors(spark, FIVE), FIVE), {"V2": (0.45, 0.55), "V3": (0.55, 0.45), "V4": (0.325, 0.675), "V5": (0.255, 0.745)})


def test_does_not_stop_before_beliefs_settle(spark):
    close(read(bp.beliefs(spark, SYM, {}, 1e-9), SYM), {"C": (0.33, 0.67)})


def test_unsettled_is_told(spark):
    assert not any(r.converged for r in bp.beliefs(spark, CHAIN, {"D": 2}, 1e-12, max_rounds=1).collect())
    assert all(r.converged for r in bp.beliefs(spark, CHAIN, {"D": 2}, 1e-12).collect())


def test_impossible_evidence(spark):
    impossible = {"W": 1, "R": 0}
    assert all(p is None for p in read(exact.posteriors(spark, PEARL, impossible), PEARL)["S"] + read(exact.posteriors(spark, PEARL, impossible), PEARL)["H"])
    assert None in read(bp.beliefs(spark, PEARL, {"R": 0, "H": 1}), PEARL)["S"]
    with pytest.raises(NetworkError, match="only 0"):
        sampling.rejection_sampling(spark, PEARL, impossible, 10, max_rounds=3)
    close(read(sampling.likelihood_weighting(spark, PEARL, impossible, 50, guard="uniform"), PEARL), {"S": (0.5, 0.5)})
    assert read(sampling.likelihood_weighting(spark, PEARL, impossible, 50), PEARL)["S"] == [None, None]


def test_soft_evidence(spark):
    over = read(bp.beliefs(spark, SYM, {}, 1e-12, soft={"A": [0.3, 0.7]}, soft_mode="override"), SYM)
    close(over, {"A": (0.155172, 0.844828), "B": (0.34, 0.66)})
    like = read(bp.beliefs(spark, SYM, {}, 1e-12, soft={"A": [0.3, 0.7]}), SYM)
    a = 0.2 * 0.3 / (0.2 * 0.3 + 0.8 * 0.7)
    close(like, {"A": (a, 1 - a), "B": (a * 0.9 + (1 - a) * 0.1, a * 0.1 + (1 - a) * 0.9)})


def test_many_rows_with_missing_values(spark):
    rows = spark.createDataFrame([(1, 0, None), (2, None, 1), (3, None, None)], "query_id long, A int, C int")
    got = {(r.query_id, r.var_id, r.state): r.p for r in bp.propagate(rows, CHAIN, 1e-12).collect()}
    assert [got[1, 2, s] for s in range(3)] == pytest.approx([0.2, 0.3, 0.5])
    assert [got[2, 2, s] for s in range(3)] == pytest.approx([0.330579, 0.173554, 0.495868], abs=1e-6)
    assert len(got) == 3 * 11


def brute(model, evidence):
    net = model.network
    mass = {v.name: np.zeros(v.card) for v in net.variables}
    for states in configurations(v.card for v in net.variables):
        at = dict(zip((v.name for v in net.variables), states))
        if all(at[k] == s for k, s in evidence.items()):
            p = math.prod(model.row(v, tuple(at[x.name] for x in net.parents(v)))[at[v.name]] for v in net.variables)
            for k, s in at.items():
                mass[k][s] += p
    return {k: x / x.sum() for k, x in mass.items()}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_propagation_is_exact_on_random_polytrees(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 7))
    net = Network.of({f"x{i}": int(rng.integers(2, 4)) for i in range(n)})
    for i in range(1, n):
        a, b = f"x{i}", f"x{rng.integers(0, i)}"
        net = net.require_edge(*((a, b) if rng.random() < 0.5 else (b, a)))
    model = Model(net, {v.id: {c: tuple(rng.dirichlet(np.ones(v.card))) for c in configurations(p.card for p in net.parents(v))} for v in net.variables})
    evidence = {f"x{rng.integers(0, n)}": 0}
    belief, converged = Propagation(model).run({net[k].id: np.array([s]) for k, s in evidence.items()}, {}, 1, 1e-13, 200)
    assert converged.all()
    for k, p in brute(model, evidence).items():
        assert belief[net[k].id][0] == pytest.approx(p, abs=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_elimination_on_random_networks(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 8))
    net = Network.of({f"x{i}": int(rng.integers(1, 4)) for i in range(n)})
    for i in range(n):
        for j in range(i):
            if rng.random() < 0.4:
                net = net.require_edge(f"x{j}", f"x{i}")
    model = Model(net, {v.id: {c: tuple(rng.dirichlet(np.ones(v.card))) for c in configurations(p.card for p in net.parents(v))} for v in net.variables})
    evidence = {f"x{i}": int(rng.integers(0, net[f"x{i}"].card)) for i in range(n) if rng.random() < 0.3}
    engine = exact.Elimination(model)
    for k, p in brute(model, evidence).items():
        assert engine.posterior(k, evidence) == pytest.approx(p, abs=1e-9)


def test_elimination_of_rows(spark):
    rows = spark.createDataFrame([(1, 0, None), (2, None, 1), (2, None, 1), (None, None, None)], "query_id long, A int, C int")
    got = exact.posteriors_of(rows, CHAIN).collect()
    assert len(got) == 4 * 11
    for query, evidence, times in ((1, {"A": 0}, 1), (2, {"C": 1}, 2), (None, {}, 1)):
        want = {(r.var_id, r.state): r.p for r in exact.posteriors(spark, CHAIN, evidence).collect()}
        found = [r for r in got if r.query_id == query]
        assert len(found) == times * 11 and all(r.p == pytest.approx(want[r.var_id, r.state], abs=1e-12) for r in found)
    assert exact.posteriors_of(rows.limit(0), CHAIN).count() == 0
    impossible = spark.createDataFrame([(1, 1, 0)], "query_id long, W int, R int")
    assert {r.p for r in exact.posteriors_of(impossible, PEARL, variables=["S"]).collect()} == {None}


def test_elimination_refuses(spark):
    for state in (-1, 9, None):
        with pytest.raises(NetworkError, match="no state"):
            exact.posterior(spark, CHAIN, "A", {"C": state})
    with pytest.raises(Exception, match="no state 9"):
        exact.posteriors_of(spark.createDataFrame([(1, 9)], "query_id long, C int"), CHAIN).collect()
    with pytest.raises(NetworkError, match="observed"):
        exact.joint(spark, CHAIN, ["A", "C"], {"C": 1})
    with pytest.raises(NetworkError, match="cells"):
        exact.posteriors(spark, FIVE, most=4)
    assert {(r.A, r.C): r.val for r in exact.joint(spark, CHAIN, ["A", "C"]).collect()}.keys() == set(configurations([CHAIN.network["A"].card, CHAIN.network["C"].card]))


def test_samplers_come_near(spark):
    for df in (sampling.rejection_sampling(spark, FIVE, {"V4": 1, "V1": 0}, 10_000, seed=2), sampling.likelihood_weighting(spark, FIVE, {"V4": 1, "V1": 0}, 20_000, seed=2), sampling.likelihood_weighting(spark, FIVE, {"V4": 1, "V1": 0}, 20_000, seed=2, fast=True)):
        close(read(df, FIVE), {"V2": (0.64, 0.36), "V5": (0.202, 0.798)}, 0.02)
    patterns, posterior, units = sampling.make_samples(spark, PEARL, {"H": 0}, unit=5000, epsilon=0.02)
    assert units >= 2 and sum(r.n for r in patterns.collect()) == units * 5000
    close(read(posterior, PEARL), GOLDEN[1][2], 0.03)


def test_samples_do_not_depend_on_partitions(spark):
    once = sampling.forward_samples(spark, FIVE, 500, seed=4).collect()
    parts = sampling.forward_samples(spark, FIVE, 200, seed=4).union(sampling.forward_samples(spark, FIVE, 300, seed=4, start=200)).repartition(7).collect()
    assert sorted(once) == sorted(parts)


def test_accepted_samples_are_the_first_ones(spark):
    few = sampling.rejection_samples(spark, FIVE, 20, {"V5": 0}, seed=1).collect()
    want = [r for r in sorted(sampling.forward_samples(spark, FIVE, 2000, seed=1).collect()) if r.V5 == 0][:20]
    assert sorted(few) == want
