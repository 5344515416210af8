import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from credence import Model, Network
from credence.network import NetworkError, configurations
from credence.operators import cpt, graph
from credence.plans.models import CPT3, FIVE


def net(names, *edges):
    return Network.of(dict.fromkeys(names, 2), edges)


def test_linear_reach():
    n = net("abcd", ("a", "b"), ("b", "c"), ("c", "d"))
    assert all(n.reaches(x, "d") for x in "abcd")
    assert not any(n.reaches(x, "a") for x in "bcd")


def test_zigzag_reach():
    n = net("abcd", ("a", "b"), ("a", "c"), ("d", "c"))
    assert not n.reaches("a", "d") and not n.reaches("b", "d") and not n.reaches("d", "b")


def test_refused_edges():
    n = net("abcd", ("a", "b"), ("b", "c"), ("c", "d"))
    assert n.with_edge("d", "a") is None  # cycle
    assert n.with_edge("a", "a") is None  # loop
    assert n.with_edge("a", "b") is None  # there already
    assert n.with_edge("b", "a") is None  # the other way round
    assert n.with_edge("a", "zz") is None  # unknown
    assert n.with_edge("a", "d").edges[-1] == (0, 3)


def test_erasing_and_reversing():
    n = net("abc", ("a", "b"), ("b", "c"), ("a", "c"))
    assert n.without_variable("b").edges == ((0, 2),)
    assert n.without_variable("zz") is None
    assert n.without_edge("a", "b").edges == ((1, 2), (0, 2))
    assert n.without_edge("c", "a") is None
    assert n.with_reversed("a", "c") is None  # c -> a would close a cycle
    assert (1, 0) in n.with_reversed("a", "b").edges
    assert n.without_edges().variables == n.variables and not n.without_variables().variables
    assert n.clone() == n


def test_neighbours_and_order():
    n = FIVE.network
    assert [p.name for p in n.parents("V5")] == ["V2", "V3"] and [c.name for c in n.children("V2")] == ["V4", "V5"]
    assert n.in_edges("V5") == [(2, 5), (3, 5)] and n.out_edges("V1") == [(1, 2), (1, 3)]
    assert n.source((1, 2)).name == "V1" and n.target((1, 2)).name == "V2" and n.source((9, 9)) is None
    assert n.levels() == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2}
    assert [v.name for v in n.topological()] == ["V1", "V2", "V3", "V4", "V5"]


def test_diamond_chain_reach_is_fast():
    names = [f"n{i}" for i in range(91)]
    edges = [e for i in range(0, 90, 3) for e in ((names[i], names[i + 1]), (names[i], names[i + 2]), (names[i + 1], names[i + 3]), (names[i + 2], names[i + 3]))]
    n = net(names, *edges)
    assert n.reaches("n0", "n90") and not n.reaches("n90", "n0")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=25))
def test_stays_acyclic(pairs):
    n = net([f"n{i}" for i in range(7)])
    for a, b in pairs:
        n = n.with_edge(f"n{a}", f"n{b}") or n
    level = n.levels()
    assert len(level) == 7 and all(level[a] < level[b] for a, b in n.edges)


def test_frames_round_trip(spark):
    assert Network.from_frames(*FIVE.network.frames(spark), name="five") == FIVE.network
    assert {tuple(r) for r in graph.reach(*FIVE.network.frames(spark)).collect()} == {(a.id, b.id) for a in FIVE.network.variables for b in FIVE.network.variables if FIVE.network.reaches(a, b)}


def test_filter_sizes(spark):
    frame = CPT3.frame(spark)
    sizes = [cpt.where(frame, CPT3.network, "V3", c).select("config").distinct().count() for c in ({}, {"V1": 0}, {"V2": 0}, {"V1": 1, "V2": 1}, {"V3": 0})]
    assert sizes == [4, 2, 2, 1, 0]


def test_lookup(spark):
    assert CPT3.row("V3", (0, 1)) == (0.15, 0.45, 0.4)
    with pytest.raises(NetworkError):
        CPT3.row("V3", (0, 2))
    miss = spark.createDataFrame([(3, [0, 2])], "var_id int, pstate array<int>")
    with pytest.raises(Exception, match="no row for variable 3"):
        cpt.lookup(CPT3.frame(spark), miss).collect()


def test_model_checks_its_tables(spark):
    with pytest.raises(NetworkError):
        Model.of(net("ab", ("a", "b")), {"a": (0.5, 0.5), "b": {0: (1, 0)}})
    assert CPT3.is_normalised()
    assert Model.from_frame(CPT3.network, CPT3.frame(spark)) == CPT3
    assert configurations([]) == [()] and configurations([2, 2]) == [(0, 0), (0, 1), (1, 0), (1, 1)]
