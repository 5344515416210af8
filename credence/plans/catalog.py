"""The engine's queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix
from ..functions.cut import cut, shared_folder
from ..network import Model, Network
from ..operators import bp, counts, cpt, exact, graph, info, learn, sampling, score
from ..operators.counts import Family
from ..sources import adjacency, bif, dot, dsc, samples
from ..streaming import counts as streaming
from . import models as m
from . import sql as q

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """-0.0 becomes 0.0, so that results compare by value."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


# --- discretisation, counting ---------------------------------------------

CONV_EDGES = (("turn", "role"), ("role", "size"))
CONV_NET = m.CONV.network(*CONV_EDGES)


def _conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.compress(m.conv(spark, sf_dir), list(m.CONV.cards))


def _li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.compress(m.li(spark, sf_dir), list(m.LI.cards))


def _cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.compress(m.cust(spark, sf_dir), list(m.CUST.cards), "n")


for _name, _model, _rows in (("lineitem", m.LI, m.li), ("conv", m.CONV, m.conv), ("events", m.EV, m.ev), ("doc", m.DOC, m.doc)):
    _query(_model.sql, f"discretize_{_name}")(_rows)


def _contingency_sql(model: m.Coded) -> str:
    return f"SELECT {', '.join(model.cards)}, count(*) AS n FROM ({model.sql}) GROUP BY ALL"


for _name, _model, _rows in (("conv", m.CONV, _conv), ("li", m.LI, _li), ("cust", m.CUST, _cust)):
    _query(_contingency_sql(_model), f"contingency_{_name}")(_rows)


@_query("SELECT count(*) AS n FROM conversations")
def sampling_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conv(spark, sf_dir).agg(F.sum("n").cast("long").alias("n"))


LI_FAMILIES = [Family("flag"), Family("status", ("flag",)), Family("qty", ("flag",)), Family("disc", ("qty",)), Family("tax", ("flag", "status"))]


def _family_sql(families: list[Family], model: m.Coded) -> str:
    parts = []
    for i, f in enumerate(families):
        at = q.config(Network.of(model.cards, [(p, f.target) for p in sorted(f.parents, key=list(model.cards).index)]), f.target)
        parts.append(f"SELECT {i} AS family, {at} AS config, {f.target} AS state, count(*) AS n FROM m GROUP BY ALL")
    return f"WITH m AS ({model.sql}) " + " UNION ALL ".join(parts)


@_query(_family_sql(LI_FAMILIES, m.LI))
def family_counts_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.family_counts(_li(spark, sf_dir), LI_FAMILIES, m.LI.cards)


@_query(f"WITH m AS ({m.LI.sql}) SELECT grouping_id(flag, status, qty, disc, tax) AS gid, flag, status, qty, disc, tax, count(*) AS n FROM m GROUP BY GROUPING SETS ((flag), (flag, status), (flag, qty), (qty, disc), (flag, status, tax))")
def grouping_sets_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.grouping_set_counts(_li(spark, sf_dir), LI_FAMILIES, list(m.LI.cards))


@_query("SELECT a, b, c FROM (SELECT CAST(range AS INTEGER) AS a FROM range(2)) x, (SELECT CAST(range AS INTEGER) AS b FROM range(3)) y, (SELECT CAST(range AS INTEGER) AS c FROM range(2)) z")
def all_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpt.assignments(spark, [2, 3, 2]).select(*[F.get("pstate", F.lit(i)).alias(c) for i, c in enumerate("abc")])


# --- tables ----------------------------------------------------------------


def _fit_sql(unseen: str) -> str:
    return f"WITH m AS ({m.CONV.sql}), {q.fitted(CONV_NET, 'm', unseen)} SELECT var_id, config, state, round(p, 9) AS p FROM cpt"


def _fitted(unseen: str) -> Query:
    return lambda spark, sf_dir: rounded(cpt.fit(_conv(spark, sf_dir), CONV_NET, unseen).select("var_id", "config", "state", "p"), 9, "p")


_query(_fit_sql("uniform"), "cpt_uniform_conv")(_fitted("uniform"))
_query(_fit_sql("zero"), "cpt_zero_conv")(_fitted("zero"))


@_query(" UNION ALL ".join(f"SELECT {v.id} AS var_id, config, state, 0e0 AS p FROM ({q.cells(CONV_NET, v.name)})" for v in CONV_NET.variables))
def cpt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpt.zeros(spark, CONV_NET).select("var_id", "config", "state", "p")


_V3 = f"WITH {q.tables(m.CPT3)} SELECT V1 * 2 + V2 AS config, V3 AS state, p FROM t_V3"


@_query(f"SELECT CAST(config AS BIGINT) AS config, state, p FROM ({_V3} WHERE V2 = 0)")
def cpt_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpt.where(m.CPT3.frame(spark), m.CPT3.network, "V3", {"V2": 0}).select("config", "state", "p")


@_query(f"SELECT DISTINCT CAST(config AS BIGINT) AS config FROM ({_V3})")
def cpt_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpt.patterns(m.CPT3.frame(spark), m.CPT3.network["V3"].id).select("config")


@_query(f"SELECT state, p FROM ({_V3} WHERE V1 = 0 AND V2 = 1)")
def cpt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(m.CPT3.network["V3"].id, [0, 1])], "var_id int, pstate array<int>")
    return cpt.lookup(m.CPT3.frame(spark), asked).select("state", "p")


@_query(f"WITH m AS ({m.CONV.sql}), {q.fitted(CONV_NET, 'm')} SELECT var_id, config, round(sum(p), 9) AS total FROM cpt GROUP BY ALL")
def cpt_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cpt.row_sums(cpt.fit(_conv(spark, sf_dir), CONV_NET)), 9, "total")


# --- graphs ----------------------------------------------------------------

FIVE = m.FIVE.network
_E = q.values(list(FIVE.edges), "e(src, dst)")
_N = q.values([(v.id,) for v in FIVE.variables], "v(var_id)")
_REACH = f"WITH RECURSIVE edge AS (SELECT * FROM {_E}), r(src, dst) AS (SELECT var_id, var_id FROM {_N} UNION SELECT r.src, edge.dst FROM r JOIN edge ON r.dst = edge.src)"


def _five(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return FIVE.frames(spark)


@_query(f"SELECT var_id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS children FROM (SELECT src AS var_id, dst FROM {_E}) GROUP BY var_id")
def graph_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.children(_five(spark)[1]).select("var_id", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


@_query(f"SELECT var_id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS parents FROM (SELECT dst AS var_id, src FROM {_E}) GROUP BY var_id")
def graph_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.parents(_five(spark)[1]).select("var_id", F.array_join(F.transform("parents", lambda x: x.cast("string")), ",").alias("parents"))


@_query(f"{_REACH} SELECT DISTINCT src, dst FROM r")
def graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(*_five(spark))


@_query(f"WITH RECURSIVE edge AS (SELECT * FROM {_E}), l(var_id, level) AS (SELECT var_id, 0 FROM {_N} UNION SELECT edge.dst, level + 1 FROM l JOIN edge ON l.var_id = edge.src) SELECT var_id, max(level) AS level FROM l GROUP BY var_id")
def graph_topo_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(_five(spark)[0], _five(spark)[1])


@_query(f"{_REACH} SELECT a.var_id AS src, b.var_id AS dst FROM {_N.replace('v(', 'a(')}, {_N.replace('v(', 'b(')} WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.src = b.var_id AND r.dst = a.var_id) AND NOT EXISTS (SELECT 1 FROM edge WHERE edge.src = a.var_id AND edge.dst = b.var_id)")
def graph_can_add_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.addable(*_five(spark))


@_query(f"SELECT CASE WHEN src = 2 AND dst = 4 THEN 4 ELSE src END AS src, CASE WHEN src = 2 AND dst = 4 THEN 2 ELSE dst END AS dst FROM {_E}")
def graph_reverse_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reversed_edge(_five(spark)[1], 2, 4)


@_query(f"SELECT src, dst FROM {_E} WHERE src <> 2 AND dst <> 2")
def graph_erase_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.without_variable(*_five(spark), 2)[1]


@_query(f"SELECT src, dst FROM {_E} WHERE NOT (src = 1 AND dst = 3)")
def graph_erase_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.without_edges(_five(spark)[1], spark.createDataFrame([(1, 3)], "src int, dst int"))


@_query(f"""WITH edge AS (SELECT * FROM {_E}), v AS (SELECT * FROM {_N})
SELECT 'add_vertex' AS step, (SELECT count(*) FROM v) + 1 AS vertices, (SELECT count(*) FROM edge) AS edges, (SELECT max(var_id) FROM v) + 1 AS a, 3 AS b
UNION ALL SELECT 'erase_all_edges', (SELECT count(*) FROM v), 0, NULL, NULL UNION ALL SELECT 'erase_all_vertices', 0, 0, NULL, NULL
UNION ALL SELECT 'clone', (SELECT count(*) FROM v), (SELECT count(*) FROM edge), NULL, NULL UNION ALL SELECT 'copy', (SELECT count(*) FROM v), (SELECT count(*) FROM edge), NULL, NULL
UNION ALL SELECT 'ends', NULL, NULL, src, dst FROM edge UNION ALL SELECT 'search', NULL, NULL, 3, 2
UNION ALL SELECT 'out', NULL, NULL, src, dst FROM edge WHERE src = 2 UNION ALL SELECT 'in', NULL, NULL, src, dst FROM edge WHERE dst = 5 UNION ALL SELECT 'condition', NULL, NULL, dst, src FROM edge""")
def graph_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a network value gives: new vertices, erasing, copies that later changes leave alone, the ends of edges, a search by name, the nodes a table depends on."""
    net, added = FIVE, FIVE.with_variable("V6", 3)
    copy, twin = net.clone(), Network.from_frames(*net.frames(spark))
    net = net.without_edge(1, 2)
    size = lambda step, n, a=None, b=None: (step, len(n.variables), len(n.edges), a, b)
    rows = [size("add_vertex", added, added["V6"].id, added["V6"].card), size("erase_all_edges", net.without_edges()), size("erase_all_vertices", net.without_variables()), size("clone", copy), size("copy", twin)]
    rows += [("ends", None, None, FIVE.source(e).id, FIVE.target(e).id) for e in FIVE.edges] + [("search", None, None, FIVE["V3"].id, FIVE["V3"].card)]
    rows += [("out", None, None, *e) for e in FIVE.out_edges("V2")] + [("in", None, None, *e) for e in FIVE.in_edges("V5")] + [("condition", None, None, v.id, p.id) for v in FIVE.variables for p in FIVE.parents(v)]
    return spark.createDataFrame(rows, "step string, vertices long, edges long, a int, b int")


@_query(f"SELECT var_id FROM {_N}")
def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _five(spark)[0].select("var_id")


# --- information and scores -------------------------------------------------


def _entropy_sql(names: tuple[str, ...], source: str = "m") -> str:
    return f"(SELECT -sum(x * log2(x)) FROM (SELECT count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM {source}) AS x FROM {source} GROUP BY {', '.join(names)}))"


@_query(f"WITH m AS ({m.LI.sql}) " + " UNION ALL ".join(f"SELECT '{v}' AS variable, round({_entropy_sql((v,))}, 6) AS entropy" for v in m.LI.cards))
def entropy_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(m.LI.cards)
    h = info.entropies(_li(spark, sf_dir), [[v] for v in names], m.LI.cards)
    return rounded(h.select(F.get(F.array(*map(F.lit, names)), F.col("place")).alias("variable"), "entropy"), 6, "entropy")


CUST_PAIRS = list(combinations(m.CUST.cards, 2))


@_query(f"WITH m AS ({m.CUST.sql}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_entropy_sql((a, b))}, 6) AS entropy" for a, b in CUST_PAIRS))
def joint_entropy_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = info.entropies(_cust(spark, sf_dir), CUST_PAIRS, m.CUST.cards)
    of = lambda k: F.get(F.array(*[F.lit(p[k]) for p in CUST_PAIRS]), F.col("place"))
    return rounded(h.select(of(0).alias("a"), of(1).alias("b"), "entropy"), 6, "entropy")


_MI = f"WITH m AS ({m.CONV.sql}), mi AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_entropy_sql((a,))} + {_entropy_sql((b,))} - {_entropy_sql((a, b))} AS mi" for a, b in combinations(m.CONV.cards, 2)) + ")"


def _mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info.mi_matrix(_conv(spark, sf_dir), list(m.CONV.cards), m.CONV.cards)


@_query(f"{_MI} SELECT a, b, round(mi, 6) AS mi FROM mi")
def mi_matrix_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_mi(spark, sf_dir), 6, "mi")


@_query(f"{_MI} SELECT a, b, round(mi, 6) AS mi FROM mi ORDER BY mi.mi DESC, a, b LIMIT 1")
def mi_top1_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(info.strongest_pair(_mi(spark, sf_dir)), 6, "mi")


@_query(f"{_MI} SELECT round(avg(mi), 6) AS average FROM mi")
def mi_average_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(info.average_similarity(_mi(spark, sf_dir)), 6, "average")


@_query(f"{_MI} SELECT 0 AS ca, 1 AS cb, round(avg(mi), 6) AS similarity FROM mi WHERE (a = 'role' OR b = 'role')")
def cluster_linkage_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = spark.createDataFrame([("role", 0), ("turn", 1), ("size", 1)], "variable string, cluster int")
    return rounded(info.linkage(_mi(spark, sf_dir), clusters), 6, "similarity")


_FAMILIES = [(v.name, tuple(p.name for p in CONV_NET.parents(v))) for v in CONV_NET.variables]
_COST = " + ".join(q.local_cost(t, ps) for t, ps in _FAMILIES)
_FREE = sum(q.free(t, ps, m.CONV.cards) for t, ps in _FAMILIES)


def _one(spark: SparkSession, value: float, name: str) -> DataFrame:
    return spark.createDataFrame([(float(value),)], f"{name} double").select(F.round(name, 6).alias(name))


@_query(f"WITH m AS ({m.CONV.sql}) SELECT round({_COST}, 6) AS cost")
def loglik_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.family_costs(_conv(spark, sf_dir), score.network_families(CONV_NET), m.CONV.cards).agg(F.sum("cost").alias("cost")), 6, "cost")


@_query(f"SELECT CAST({_FREE} AS BIGINT) AS parameters")
def params_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(score.network_parameters(CONV_NET),)], "parameters long")


@_query(f"WITH m AS ({m.CONV.sql}) SELECT round({_COST} + {_FREE}, 6) AS score")
def aic_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, score.aic(_conv(spark, sf_dir), CONV_NET), "score")


@_query(f"WITH m AS ({m.CONV.sql}) SELECT round({_COST} + {_FREE} * log2((SELECT count(*) FROM m)) / 2, 6) AS score")
def mdl_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, score.mdl(_conv(spark, sf_dir), CONV_NET), "score")


CONV_NAMES = tuple(m.CONV.cards)


@_query(f"WITH m AS ({m.CONV.sql}), {q.all_local(CONV_NAMES, m.CONV.cards, 2)} SELECT target, parents, round(cost, 6) AS cost FROM local")
def local_scores_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _conv(spark, sf_dir)
    families = [Family(t, ps) for t in CONV_NAMES for k in range(3) for ps in combinations(sorted(set(CONV_NAMES) - {t}), k)]
    costs = score.family_costs(table, families, m.CONV.cards)
    known = spark.createDataFrame([(i, f.target, ",".join(f.parents), score.parameters(f, m.CONV.cards)) for i, f in enumerate(families)], "family int, target string, parents string, free long")
    size = table.agg(F.sum("n").alias("size"))
    both = costs.join(F.broadcast(known), "family").join(F.broadcast(size))
    return both.select("target", "parents", F.round(F.col("cost") + F.col("free") * F.log2(F.col("size").cast("double")) / 2, 6).alias("cost"))


# --- structure search --------------------------------------------------------

EMPTY = m.CONV.network()


def _scores(table: DataFrame, cards: dict[str, int]) -> score.ScoreCache:
    """Over the written counts: the search reads them again and again."""
    return score.ScoreCache(cut(table), cards)


def _conv_scores(spark: SparkSession, sf_dir: str) -> score.ScoreCache:
    return _scores(_conv(spark, sf_dir), m.CONV.cards)


@_query(q.best_of(q.dags(CONV_NAMES), CONV_NAMES, m.CONV.cards, m.CONV.sql))
def bruteforce_best_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, learn.exhaustive(EMPTY, _conv_scores(spark, sf_dir)).score, "score")


@_query(q.best_of(q.dags(CONV_NAMES, forest=True), CONV_NAMES, m.CONV.cards, m.CONV.sql))
def bruteforce_restricted_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, learn.exhaustive(EMPTY, _conv_scores(spark, sf_dir), mode="restricted").score, "score")


_HINTED = [{"role": (), "turn": (), "size": ps} for ps in ((), ("role",), ("turn",), ("role", "turn"))]


@_query(q.best_of(_HINTED, CONV_NAMES, m.CONV.cards, m.CONV.sql))
def hint_best_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, learn.exhaustive_with_hint(EMPTY, _conv_scores(spark, sf_dir), ["role", "turn"], ["size"]).score, "score")


def _edges(spark: SparkSession, found: learn.Learned) -> DataFrame:
    rows = [(found.network[a].name, found.network[b].name, round(found.score, 6)) for a, b in found.network.edges]
    return spark.createDataFrame(rows or [(None, None, round(found.score, 6))], "parent string, child string, score double")


@_query(q.in_steps([("role", "turn"), ("role", "size"), ("turn", "size")], CONV_NAMES, m.CONV.cards, m.CONV.sql))
def greedy_fixed_order_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, learn.greedy(EMPTY, _conv_scores(spark, sf_dir), seed=None))


@_query(q.in_steps([("size", "turn")], CONV_NAMES, m.CONV.cards, m.CONV.sql))
def greedy_hint_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, learn.greedy_with_hint(EMPTY, _conv_scores(spark, sf_dir), ["turn"], ["size"], seed=None))


@_query(q.in_steps([("role", "turn"), ("turn", "role"), ("turn", "size"), ("size", "role"), ("size", "turn")], CONV_NAMES, m.CONV.cards, m.CONV.sql))
def k2_fixed_order_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, learn.k2(EMPTY, _conv_scores(spark, sf_dir), {"role": ["size"]}, seed=None))


@_query(f"WITH m AS ({m.CUST.sql}), {q.best_by_sets(tuple(m.CUST.cards), m.CUST.cards, 'm')} SELECT round(cost, 6) AS score, round(cost, 6) AS edges_score FROM best")
def exhaustive_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimum, and the score of the edges found, counted anew; which of the equally good structures they are is left open."""
    table = _cust(spark, sf_dir)
    found = learn.exhaustive(m.CUST.network(), _scores(table, m.CUST.cards))
    return spark.createDataFrame([(round(found.score, 6), round(score.mdl(table, found.network), 6))], "score double, edges_score double")


_SYN_NAMES = tuple(v.name for v in FIVE.variables)
_SYN = f"WITH {q.sampled(m.FIVE, 20_000, 5)}, m AS (SELECT {', '.join(_SYN_NAMES)} FROM s), {q.best_by_sets(_SYN_NAMES, score.cards_of(FIVE), 'm')} SELECT round({' + '.join(q.local_mdl(n, (), score.cards_of(FIVE)) for n in _SYN_NAMES)}, 6) AS start, round(cost, 6) AS optimum, TRUE AS acyclic, TRUE AS consistent, TRUE AS within FROM best"


def _held(spark: SparkSession, search: Callable[[score.ScoreCache], learn.Learned]) -> DataFrame:
    """A search with a seed, held against what must be true of any: its edges form no cycle, their score counted anew is the one returned, and it lies between that of no edges, where it began, and the optimum."""
    table = counts.compress(sampling.forward_samples(spark, m.FIVE, 20_000, seed=5), list(_SYN_NAMES))
    scores = _scores(table, score.cards_of(FIVE))
    found, best, start = search(scores), learn.exhaustive(FIVE.without_edges(), scores).score, scores.total(FIVE.without_edges())
    acyclic = len(found.network.levels()) == len(FIVE.variables)
    consistent = abs(score.mdl(table, found.network) - found.score) < 1e-6
    return spark.createDataFrame([(round(start, 6), round(best, 6), acyclic, consistent, best - 1e-6 <= found.score <= start + 1e-6)], "start double, optimum double, acyclic boolean, consistent boolean, within boolean")


@_query(_SYN)
def anneal_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, lambda scores: learn.anneal(FIVE.without_edges(), scores, initial=500.0, final=0.5, rate=0.98, best_seen=True, seed=3))


@_query(_SYN)
def stepwise_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, lambda scores: learn.stepwise(FIVE, scores, cluster_size=2, inner="exhaustive", between="exhaustive", seed=3))


@_query(_SYN)
def stepwise_hc_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, lambda scores: learn.stepwise_hierarchical(FIVE, scores, alpha=0.3, seed=3))


def _bdeu_sql(target: str, parents: tuple[str, ...]) -> str:
    states, rows = m.CONV.cards[target], q.free(target, parents, m.CONV.cards) // (m.CONV.cards[target] - 1)
    a, keys = 4 / (rows * states), ", ".join(parents)
    cells = f"SELECT sum(lgamma(n + {a!r}) - lgamma({a!r})) FROM (SELECT count(*) AS n FROM m GROUP BY {', '.join((*parents, target))})"
    totals = f"SELECT sum(lgamma(n + {a * states!r}) - lgamma({a * states!r})) FROM (SELECT count(*) AS n FROM m {'GROUP BY ' + keys if keys else ''})"
    return f"SELECT '{target}' AS target, '{','.join(parents)}' AS parents, round((({totals}) - ({cells})) / ln(2), 4) AS cost"


_CONV_FAMILIES = [Family(t, ps) for t in CONV_NAMES for k in range(3) for ps in combinations(sorted(set(CONV_NAMES) - {t}), k)]


@_query(f"WITH m AS ({m.CONV.sql}) " + " UNION ALL ".join(_bdeu_sql(*f) for f in _CONV_FAMILIES))
def bdeu_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score plugged in: the marginal likelihood of every family under four prior samples."""
    scores = score.ScoreCache(_conv(spark, sf_dir), m.CONV.cards, local=score.bdeu(4.0))
    scores.load(_CONV_FAMILIES)
    return spark.createDataFrame([(f.target, ",".join(f.parents), round(scores.local(*f), 4)) for f in _CONV_FAMILIES], "target string, parents string, cost double")


_PRUNED = [(0.5, 1.0, 2.0, 0.1, 0.2, None), (0.3, 0.4, 0.5, 0.1, 0.2, None), (0.5, 1.0, 2.0, 0.5, None, 1.0), (0.5, 1.0, 2.0, None, 0.25, 1.0)]


@_query("SELECT id, round(CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN alpha ** (fresh / average) ELSE alpha ** (merged / coalesce(l, r)) END, 9) AS p FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in (i, *r)) + ")" for i, r in enumerate(_PRUNED)) + ") AS v(id, alpha, fresh, average, l, r, merged)")
def prune_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, round(learn.prune_probability(*r), 9)) for i, r in enumerate(_PRUNED)], "id int, p double")


# --- inference ----------------------------------------------------------------


def _posterior_queries() -> None:
    cases = {
        "pearl": (m.PEARL, {}), "pearl_h0": (m.PEARL, {"H": 0}), "chain_b2_d0": (m.CHAIN, {"B": 2, "D": 0}), "chain_c1": (m.CHAIN, {"C": 1}), "chain_a1_c1": (m.CHAIN, {"A": 1, "C": 1}),
        "chain_d2": (m.CHAIN, {"D": 2}), "chain_a0": (m.CHAIN, {"A": 0}), "five": (m.FIVE, {}), "five_v4_v1": (m.FIVE, {"V4": 1, "V1": 0}), "five_v5": (m.FIVE, {"V5": 0}),
    }
    for name, (model, evidence) in cases.items():
        text = q.posterior(model, evidence)
        _query(text, f"posterior_{name}")(lambda spark, sf_dir, model=model, evidence=evidence: rounded(exact.posteriors(spark, model, evidence), 6, "p"))
        if model is not m.FIVE or name == "five_v4_v1":  # elsewhere the loop makes propagation inexact
            _query(text, f"bp_{name}")(lambda spark, sf_dir, model=model, evidence=evidence: rounded(bp.beliefs(spark, model, evidence, 1e-12).drop("converged"), 6, "p"))
    _query(q.posterior(m.PEARL, {"H": 0}), "bp_relational_pearl_h0")(lambda spark, sf_dir: rounded(bp.relational(spark, m.PEARL, {"H": 0}), 6, "p"))
    _query(None, "bp_five_loopy")(lambda spark, sf_dir: rounded(bp.beliefs(spark, m.FIVE, {"V5": 0}, 1e-12), 6, "p"))


_posterior_queries()

_CONV_P = f"WITH m AS ({m.CONV.sql}), {q.fitted(CONV_NET, 'm')}, "


def _posterior_given_turn_sql(turn: str) -> str:
    """P(size | turn) along turn -> role -> size; `turn` is an expression over t(turn)."""
    role, size = CONV_NET["role"].id, CONV_NET["size"].id
    return f"SELECT t.turn, b.state, round(sum(a.p * b.p), 6) AS p FROM {turn} JOIN cpt a ON a.var_id = {role} AND a.config = t.turn JOIN cpt b ON b.var_id = {size} AND b.config = a.state GROUP BY t.turn, b.state"


@_query(_CONV_P + "x AS (" + _posterior_given_turn_sql("(SELECT 0 AS turn) t") + ") SELECT state, p FROM x")
def posterior_exact_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations -> codes -> tables of turn -> role -> size -> P(size | turn = 0)."""
    model = cpt.fit_model(_conv(spark, sf_dir), CONV_NET)
    return rounded(exact.posterior(spark, model, "size", {"turn": 0}), 6, "p")


flagship = posterior_exact_conv


@_query(_CONV_P + "x AS (" + _posterior_given_turn_sql("(SELECT DISTINCT turn FROM m) t") + ") SELECT CAST(turn AS BIGINT) AS query_id, state, p FROM x")
def bp_conv_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _conv(spark, sf_dir)
    model = cpt.fit_model(table, CONV_NET)
    asked = table.select("turn").distinct().select(F.col("turn").alias("query_id"), "turn")
    return rounded(bp.propagate(asked, model, 1e-12, variables=["size"]).select("query_id", "state", "p"), 6, "p")


LI_NET = m.LI.network(("flag", "status"), ("flag", "qty"), ("flag", "disc"), ("flag", "tax"))
_EVIDENCE = ("status", "qty", "disc", "tax")


def _li_posterior_sql() -> str:
    joins = " ".join(f"JOIN cpt c_{v} ON c_{v}.var_id = {LI_NET[v].id} AND c_{v}.config = f.state AND c_{v}.state = e.{v}" for v in _EVIDENCE)
    product = " * ".join(["f.p", *(f"c_{v}.p" for v in _EVIDENCE)])
    keys = ", ".join(f"e.{v}" for v in _EVIDENCE)
    inner = f"SELECT {keys}, f.state, {product} AS x FROM (SELECT DISTINCT {', '.join(_EVIDENCE)} FROM m) e JOIN cpt f ON f.var_id = {LI_NET['flag'].id} {joins}"
    return f"WITH m AS ({m.LI.sql}), {q.fitted(LI_NET, 'm')} SELECT {', '.join(_EVIDENCE)}, state, round(x / sum(x) OVER (PARTITION BY {', '.join(_EVIDENCE)}), 6) AS p FROM ({inner})"


def _score_lineitem(spark: SparkSession, sf_dir: str, infer: Callable[[DataFrame, Model], DataFrame]) -> DataFrame:
    """P(return flag | everything else) for every distinct evidence row."""
    table = cut(_li(spark, sf_dir))
    model = cpt.fit_model(table, LI_NET)
    rows = table.select(*_EVIDENCE).distinct().withColumn("query_id", counts.mixed_radix(_EVIDENCE, m.LI.cards))
    found = infer(rows, model)
    back = {}
    at = F.col("query_id")
    for v in reversed(_EVIDENCE):
        back[v] = (at % m.LI.cards[v]).cast("int")
        at = F.floor(at / m.LI.cards[v])
    return found.select(*[back[v].alias(v) for v in _EVIDENCE], "state", (F.round("p", 6) + F.lit(0.0)).alias("p"))


@_query(_li_posterior_sql())
def bp_score_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In one pass of batched propagation."""
    return _score_lineitem(spark, sf_dir, lambda rows, model: bp.propagate(rows, model, 1e-9, variables=["flag"]))


@_query(_li_posterior_sql())
def posterior_score_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By elimination, each batch of rows in its task."""
    return _score_lineitem(spark, sf_dir, lambda rows, model: exact.posteriors_of(rows, model, variables=["flag"]))


_FIVE_ROWS = [{"V5": 0}, {"V4": 1, "V1": 0}, {"V2": 1, "V3": 0, "V5": 1}, {}]


@_query(" UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query_id, * FROM ({q.posterior(m.FIVE, e)})" for i, e in enumerate(_FIVE_ROWS)))
def posterior_five_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network with a loop, rows with different variables observed."""
    names = [v.name for v in m.FIVE.network.variables]
    rows = spark.createDataFrame([(i, *(e.get(n) for n in names)) for i, e in enumerate(_FIVE_ROWS)], "query_id long, " + ", ".join(f"{n} int" for n in names))
    return rounded(exact.posteriors_of(rows, m.FIVE), 6, "p")


_N_SAMPLES = 20_000


@_query(f"WITH {q.sampled(m.FIVE, _N_SAMPLES, 11)} SELECT V1, V2, V3, V4, V5, count(*) AS n FROM s GROUP BY ALL")
def forward_sample_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.compress(sampling.forward_samples(spark, m.FIVE, _N_SAMPLES, seed=11), [v.name for v in FIVE.variables])


@_query(f"WITH {q.sampled(m.PEARL, 200_000, 12)}, k AS (SELECT * FROM s WHERE H = 0 ORDER BY i LIMIT 10000) {q.frequencies(m.PEARL, 'k')}")
def rejection_pearl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.rejection_sampling(spark, m.PEARL, {"H": 0}, 10_000, seed=12), 9, "p")


@_query(f"WITH {q.sampled(m.PEARL, _N_SAMPLES, 13, {'H': 0})} {q.frequencies(m.PEARL, 's', 6)}")
def lw_pearl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.likelihood_weighting(spark, m.PEARL, {"H": 0}, _N_SAMPLES, seed=13), 6, "p")


@_query(f"WITH {q.sampled(m.PEARL, 40_000, 14, {'H': 0})} SELECT R, S, W, H, count(*) AS n FROM s GROUP BY ALL")
def lw_make_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.make_samples(spark, m.PEARL, {"H": 0}, unit=20_000, epsilon=0.05, seed=14)[0]


@_query("SELECT k, CASE WHEN sum(x) OVER (PARTITION BY k) < 1e-20 THEN 1e0 / count(*) OVER (PARTITION BY k) ELSE x / sum(x) OVER (PARTITION BY k) END AS x FROM " + q.values([(1, 1.0), (1, 3.0), (2, 0.0), (2, 0.0)], "v(k, x)"))
def normalize_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info.normalised(spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 0.0), (2, 0.0)], "k int, x double"), ["k"], "x", guard=True)


# --- sources, matrices, streams -------------------------------------------------

_GRID = ",1,2,3,4,5\n1, ,*,*, , \n2, , , ,*,*\n3, , , , ,*\n4, , , , , \n5, , , , , "
_LINES = list(enumerate(_GRID.split("\n")))


@_query("SELECT r.i AS src, c.i AS dst FROM (SELECT row_no AS i, string_split(v, ',') AS f FROM " + q.values(_LINES[1:], "l(row_no, v)") + ") r, (SELECT CAST(range AS INTEGER) AS i FROM range(1, 6)) c WHERE r.f[c.i + 1] = '*'")
def adjacency_csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    variables = spark.createDataFrame([(i, v.id) for i, v in enumerate(FIVE.variables)], "position int, var_id int")
    return adjacency.load(spark.createDataFrame(_LINES, "line_no int, value string"), variables)


@_query("SELECT line_no, value FROM " + q.values(_LINES, "l(line_no, value)"))
def adjacency_csv_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.spell(*_five(spark))


@_query(f"""SELECT 0 AS kind, id AS a, -1 AS b, 'Node' || id || ' [label="' || name || '"];' AS line FROM {q.values([(v.id, v.name) for v in FIVE.variables], 'v(id, name)')} UNION ALL SELECT 1, src, dst, 'Node' || src || ' -> Node' || dst || ';' FROM {_E}""")
def dot_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dot.lines(*_five(spark))


@_query(_contingency_sql(m.CONV))
def samples_text_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contingency table, written as a weighted sample file and read again."""
    path = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    samples.write_samples(_conv(spark, sf_dir), path, CONV_NAMES, "n")
    return samples.read_samples(spark, path, CONV_NAMES, weight_first=True)


@_query(m.CONV.sql)
def samples_lines_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without multiplicities, written as a sample file and read again."""
    path = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    samples.write_samples(m.conv(spark, sf_dir), path, CONV_NAMES)
    return samples.read_samples(spark, path, CONV_NAMES)


def _model_sql(model: Model) -> str:
    parts = [f"SELECT '{v.name}' AS variable, {q.config(model.network, v.name)} AS config, {v.name} AS state, p FROM t_{v.name}" for v in model.network.variables]
    return f"WITH {q.tables(model)} " + " UNION ALL ".join(parts)


def _tables_of(spark: SparkSession, model: Model) -> DataFrame:
    names = spark.createDataFrame([(v.id, v.name) for v in model.network.variables], "var_id int, variable string")
    return model.frame(spark).join(F.broadcast(names), "var_id").select("variable", "config", "state", "p")


DSC_TEXT = """//a network
belief network "chain"\r
node A
{
  type: discrete[3] = {"a", "b", "c"}; // three states
}
node B { type : discrete [3]; }
  node C
  {
    type: discrete[2];
  }
node D { type: discrete[3]; }
probability(A) { 0.3, 0.6, 0.1; }
probability(B | A)
{
  (0): 0.2, 0.3, 0.5;
  (1): 0.3, 0.3, 0.4;
  (2): 0.8, 0.1, 0.1;
}
probability(C | B) { (0): 0.5, 0.5; (1): 0.7, 0.3; (2): 0.4, 0.6; }
probability(D | C)
{
  (0): 0.4, 0.3, 0.3;

  (1): 0.2, 0.6, 0.2;
}
"""


@_query(_model_sql(m.CHAIN))
def dsc_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables_of(spark, dsc.parse(DSC_TEXT))


@_query(_model_sql(m.FIVE))
def dsc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables_of(spark, dsc.parse(dsc.spell(m.FIVE)))


BIF_TEXT = """network pearl { }
// rain, sprinkler, and two lawns
variable R { type discrete [ 2 ] { yes, no }; }
variable S { type discrete [ 2 ] { yes, no }; property of = "nothing"; }
variable W { type discrete [ 2 ] { wet, dry }; }
variable H { type discrete [ 2 ] { wet, dry }; }
probability ( R ) { table 0.2, 0.8; }
probability ( S ) { table 0.1, 0.9; }
probability ( W | R ) { (yes) 1.0, 0.0; (no) 0.2, 0.8; }
probability ( H | R, S ) {
  (yes, yes) 1.0, 0.0; (yes, no) 1.0, 0.0;
  (no, yes) 0.9, 0.1; (no, no) 0.0, 1.0;
}
"""


@_query(_model_sql(m.PEARL))
def bif_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables_of(spark, bif.parse(BIF_TEXT))


@_query(_model_sql(m.CPT3))
def bif_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables_of(spark, bif.parse(bif.spell(m.CPT3)))


M1, M2, M3 = ([2, -1, 2, -1, 1, 0, 1, 0, 1], [1, 0, 0, 0, 2, 0, 0, 0, 2], [-1, -1, 2, -1, 0, 2, 1, 1, -1])


def _cells(spark: SparkSession, flat: list[int]) -> DataFrame:
    return matrix.from_values(spark.createDataFrame([([float(x) for x in flat],)], "v array<double>"), "v", 3)


def _cells_sql(flat: list[int]) -> str:
    return q.values([(k // 3, k % 3, float(x)) for k, x in enumerate(flat)], "m(i, j, value)")


@_query(f"SELECT ab.i, c.j, sum(ab.value * c.value) AS value FROM (SELECT a.i, b.j, sum(a.value * b.value) AS value FROM {_cells_sql(M1).replace('m(', 'a(')} JOIN {_cells_sql(M2).replace('m(', 'b(')} ON a.j = b.i GROUP BY a.i, b.j) ab JOIN {_cells_sql(M3).replace('m(', 'c(')} ON ab.j = c.i GROUP BY ab.i, c.j")
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.product(matrix.product(_cells(spark, M1), _cells(spark, M2)), _cells(spark, M3))


@_query(f"SELECT a.i, a.j, a.value * b.value AS value FROM {_cells_sql(M1).replace('m(', 'a(')} JOIN {_cells_sql(M3).replace('m(', 'b(')} ON a.i = b.i AND a.j = b.j")
def matrix_hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.hadamard(_cells(spark, M1), _cells(spark, M3))


@_query(f"SELECT i, j, value * 5e-1 AS value FROM {_cells_sql(M1)}")
def matrix_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.scaled(_cells(spark, M1), 0.5)


@_query(f"SELECT i, j, value FROM {_cells_sql(M3)}")
def matrix_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.createDataFrame([([float(x) for x in M3],)], "v array<double>")
    return matrix.cells(one.select(matrix.assigned(F.col("v"), 3, 3).alias("m")), "m")


@_query(f"SELECT r.i, c.j, coalesce(m.value, 7e0) AS value, 4 AS height, 2 AS width, {float(M3[5])!r} AS entry FROM (SELECT CAST(range AS INTEGER) AS i FROM range(4)) r, (SELECT CAST(range AS INTEGER) AS j FROM range(2)) c LEFT JOIN {_cells_sql(M3)} ON m.i = r.i AND m.j = c.j")
def matrix_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resized to 4 x 2, with the new shape and a cell of the old one."""
    one = spark.createDataFrame([([float(x) for x in M3],)], "v array<double>").select(matrix.assigned(F.col("v"), 3, 3).alias("old")).select("old", matrix.resized(F.col("old"), 4, 2, 7.0).alias("m"))
    told = one.select(matrix.height(F.col("m")).alias("height"), matrix.width(F.col("m")).alias("width"), matrix.entry(F.col("old"), 1, 2).alias("entry"))
    return matrix.cells(one, "m").crossJoin(F.broadcast(told))  # one row


EV_FAMILIES = [Family("kind"), Family("bin", ("kind",))]


@_query(_family_sql(EV_FAMILIES, m.EV))
def stream_counts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family counts of the events as a stream that has been read to its end."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = m.ev_codes(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    name = f"counts_{uuid.uuid4().hex}"
    query = streaming.family_counts(stream, EV_FAMILIES, m.EV.cards).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select("family", "config", "state", "n")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
