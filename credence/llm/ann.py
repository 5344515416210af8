"""Nearest neighbours by largest inner product, from a hierarchical k-means tree.

The tree is fitted by k-means, level by level, on a sample of at most `SAMPLE`
vectors (those with the smallest hashes of their ids), lengthened by one
component that makes the largest inner product the smallest distance. It has at
most `MOST_LEAVES` leaves, so it may be sent everywhere. Every vector is then
indexed: it descends to the nearest centre at each level.

A query visits leaves best bin first: a priority queue over the tree's nodes,
by distance to the centre, gives the leaves in the order they would be visited.
How many to visit is calibrated: up to `CALIBRATION` queries are answered
exactly, over all rows in blocks, and the visits widen until the mean share of
their true neighbours in the visited leaves reaches `RECALL`. A query goes on
until its leaves hold k rows beside itself, so none gets fewer while there are
more.

Rows of a leaf are dealt into blocks of about `BLOCK`, and its queries into
batches of about `BATCH`, so a leaf that holds a third of all rows is many
tasks; each task scores its batch against its block in double precision and
passes on the best of each query. A row travels once for each batch of its leaf
and a query once for each block it meets, so both are large. The lists of a
query are merged in two levels, so that no task holds more than about the root
of their number at once.

Defined results for unusual input: vectors that are null, zero, or hold null or
non-finite components, and those whose dimension is not the commonest one, are
neither queries nor candidates; null ids likewise. Rows are told apart by
number, not by id: each row of a repeated id is a candidate, for its namesakes
too, and each that is a query has neighbours of its own under that id. Ties go
to the smaller id. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import materialize

SAMPLE = 20_000
CALIBRATION = 128
BRANCH = 8
#: A leaf is split while it stands for more than this many times the root of the number of rows.
LEAF = 8
MOST_LEAVES = 4096
RECALL = 0.95
BLOCK, BATCH = 4096, 4096
#: Lists of a query up to which they are merged at once.
MERGE = 256
_ROWS = 32
ITERATIONS = 10


class Tree:
    """Nodes in one array of centres; children of node i are first[i] .. first[i] + count[i]; a leaf has none and a number."""

    def __init__(self, points: np.ndarray, leaf_size: int, branch: int = BRANCH, seed: int = 7):
        self.centres, self.first, self.count, self.leaf = [points.mean(axis=0)], [0], [0], [-1]
        rng = np.random.default_rng(seed)
        queue = [(0, points)]
        self.leaves = 0
        for node, own in queue:
            groups = self._split(own, branch, rng) if len(own) > leaf_size and len(queue) < MOST_LEAVES else []
            if len(groups) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            self.first[node], self.count[node] = len(self.centres), len(groups)
            for g in groups:
                queue.append((len(self.centres), g))
                self.centres.append(g.mean(axis=0))
                self.first.append(0)
                self.count.append(0)
                self.leaf.append(-1)
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(x: np.ndarray, k: int, rng) -> list[np.ndarray]:
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(ITERATIONS):
            own = _nearest(x, centres)
            centres = np.array([x[own == j].mean(axis=0) if (own == j).any() else x[rng.integers(len(x))] for j in range(k)])
        own = _nearest(x, centres)
        return [x[own == j] for j in range(k) if (own == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        at = np.zeros(len(x), np.int64)
        out = np.empty(len(x), np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            moved = []
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                if self.leaf[node] >= 0:
                    out[rows] = self.leaf[node]
                else:
                    f = self.first[node]
                    at[rows] = f + _nearest(x[rows], self.centres[f : f + self.count[node]])
                    moved.append(rows)
            open_ = np.concatenate(moved) if moved else np.empty(0, np.int64)
        return out

    def visit(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """The first `most` leaves, best bin first, and more until they hold `rows` rows, by the sizes of the leaves."""
        apart = ((self.centres - q) ** 2).sum(axis=1)
        heap, out, held = [(0.0, 0)], [], 0
        while heap and (len(out) < most or held < rows):
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                held += 0 if sizes is None else sizes[self.leaf[node]]
            for child in range(self.first[node], self.first[node] + self.count[node]):
                heapq.heappush(heap, (apart[child], child))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def lengthened(x: np.ndarray, most: float) -> np.ndarray:
    """x with the component that brings every row to the length `most`."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most * most - (x * x).sum(axis=1)))])


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v) of the vectors that take part, before their dimension is looked at. Floats stay floats until they are scored; row is a number of its own once this is written."""
    kind = df.schema[vector_col].dataType
    v = F.col(vector_col) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    kept = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & good)
    return kept.select(F.monotonically_increasing_id().alias("row"), "id", "v")


def _merged(lists: DataFrame, k: int, *by: str) -> DataFrame:
    return lists.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def top(scores: DataFrame, k: int, parts: int = 1) -> DataFrame:
    """The k best of each query (row, id) from the lists (candidates, scores) of the blocks it was held against, merged in so many parts first."""
    of = lambda c, x: F.struct((-x).alias("s"), c.alias("c"))
    lists = scores.select("row", "id", F.pmod(F.xxhash64("leaf", "block"), F.lit(parts)).alias("part"), F.zip_with("candidates", "scores", of).alias("best"))
    if parts > 1:
        lists = _merged(lists, k, "row", "id", "part")
    whole = _merged(lists, k, "row", "id")
    return whole.select("row", "id", F.posexplode("best").alias("at", "b")).select("row", "id", (F.col("at") + 1).alias("rank"), F.col("b.c").alias("candidate"), (-F.col("b.s")).alias("score"))


def _best(q_rows, q, c_rows, c_ids, c, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the candidate, score) of the k best candidates in a block for each query of a batch, but for the query itself; ties to smaller ids.

    A matrix product finds them with a little slack; their scores are then summed one by one, so that equal vectors score exactly alike wherever they stand.
    """
    out = []
    for at in range(0, len(q), _ROWS):
        part = q[at : at + _ROWS]
        rough = part @ c.T
        rough[q_rows[at : at + _ROWS, None] == c_rows[None, :]] = -np.inf
        least = np.partition(rough, len(c_ids) - k, axis=1)[:, len(c_ids) - k, None] if len(c_ids) > k else np.full((len(part), 1), -np.inf)
        slack = 1e-12 * np.abs(part).sum(axis=1, keepdims=True) * np.abs(c).max(initial=0)
        row, col = np.nonzero((rough >= least - slack) & (rough > -np.inf))
        s = np.einsum("ij,ij->i", part[row], c[col])
        by = np.lexsort((c_ids[col], -s, row))
        row, col, s = row[by], col[by], s[by]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[keep] + at, col[keep], s[keep]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def exact(rows: DataFrame, asked: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """query (a row), candidate, score, leaf: the k best of a few given queries in each batch of the indexed rows."""
    dim = vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c_ids = batch.column(1).to_numpy()
                q, c, s = _best(asked, vectors, batch.column(0).to_numpy(), c_ids, _vectors(batch.column(2), dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(c_ids[c]), pa.array(s), batch.column(3).take(pa.array(c))], names=["query", "candidate", "score", "leaf"])

    return rows.select("row", "id", "v", "leaf").mapInArrow(run, "query long, candidate long, score double, leaf long")


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score, visits for the rows of which is_query (a column over `id`) holds, against all others."""
    spark = df.sparkSession
    rows = materialize(usable(df, id_col, vector_col), "vectors")
    kind = rows.schema["v"].dataType.simpleString()
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("m")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double, visits int"
    if dims is None:
        return spark.createDataFrame([], empty)
    dim, count, most = dims.d, dims.n, float(np.sqrt(dims.m))
    rows = rows.filter(F.size("v") == dim)
    sample = _vectors(rows.orderBy(F.xxhash64("id"), F.xxhash64("v")).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks(), dim)
    # Few leaves make long scans, many make queries travel far: both costs of a query grow as the root of the rows.
    tree = Tree(lengthened(sample, most), max(2, len(sample) * 4 // MOST_LEAVES, int(LEAF * np.sqrt(count) * len(sample) / count)))
    sent = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = sent.value.assign(lengthened(_vectors(batch.column(2), dim), most))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], names=["row", "id", "v", "leaf"])

    indexed = materialize(rows.mapInArrow(index, f"row long, id long, v {kind}, leaf long"), "indexed")
    asked = rows.filter(is_query)
    trial = asked.orderBy(F.xxhash64("id", F.lit(1)), F.xxhash64("v")).limit(CALIBRATION).collect()
    if not trial:
        return spark.createDataFrame([], empty)
    trial_rows, vectors = np.array([r.row for r in trial]), np.array([r.v for r in trial], np.float64)
    truth = exact(indexed, trial_rows, vectors, k)
    best = truth.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("candidate").alias("c"), "leaf"))), 1, k).alias("b"))
    wanted = {r["query"]: [x["leaf"] for x in r["b"]] for r in best.collect()}  # k for each of the bounded number of trials
    visits = calibrated(tree, trial_rows, lengthened(vectors, 0.0), wanted, recall)
    held = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # at most MOST_LEAVES rows
        held[r.leaf] = r["count"]
    sizes = spark.sparkContext.broadcast(held)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.column_stack([_vectors(batch.column(2), dim), np.zeros(batch.num_rows)])
            leaves = [sent.value.visit(x, visits, sizes.value, k + 1) for x in q]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], names=["row", "id", "v", "leaves"])

    routed = materialize(asked.mapInArrow(route, f"row long, id long, v {kind}, leaves array<long>"), "routed")
    visited = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()  # at most MOST_LEAVES rows
    plan = [(r.leaf, -(-int(held[r.leaf]) // BLOCK), -(-r["count"] // BATCH)) for r in visited if held[r.leaf]]
    plan = F.broadcast(spark.createDataFrame(plan, "leaf long, blocks int, batches int"))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = indexed.join(plan, "leaf").select("leaf", own("blocks").alias("block"), every("batches").alias("batch"), "row", "id", "v")
    q = routed.select("row", "id", "v", F.explode("leaves").alias("leaf")).join(plan, "leaf").select("leaf", every("blocks").alias("block"), own("batches").alias("batch"), "row", "id", "v")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"leaf": [], "block": [], "row": [], "id": [], "candidates": [], "scores": []})
        c_ids = right["id"].to_numpy()
        of = lambda side: np.stack(side["v"].to_numpy()).astype(np.float64)
        q, c, x = _best(left["row"].to_numpy(), of(left), right["row"].to_numpy(), c_ids, of(right), k)
        ends = np.searchsorted(q, np.arange(1, len(left)))
        return pd.DataFrame({"leaf": left["leaf"], "block": left["block"], "row": left["row"], "id": left["id"], "candidates": np.split(c_ids[c], ends), "scores": np.split(x, ends)})

    key = ("leaf", "block", "batch")
    scores = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(score, "leaf long, block int, row long, id long, candidates array<long>, scores array<double>")
    # A query's lists: one for each block of its leaves.
    lists = visits * max(1, -(-count // (tree.leaves * BLOCK)))
    found = top(scores, k, 1 if lists <= MERGE else int(np.sqrt(lists)))
    return found.select(F.col("id").alias("query_id"), F.col("rank").cast("int"), F.col("candidate").alias("vec_id"), "score", F.lit(visits).alias("visits"))


def calibrated(tree: Tree, ids: np.ndarray, queries: np.ndarray, wanted: dict[int, list[int]], recall: float) -> int:
    """The fewest leaf visits at which the mean share of wanted neighbours reached is `recall`."""
    reached = np.zeros(tree.leaves)
    counted = 0
    for one, q in zip(ids.tolist(), queries):
        if wanted.get(one):
            place = np.empty(tree.leaves, np.int64)
            place[tree.visit(q, tree.leaves)] = np.arange(tree.leaves)
            np.add.at(reached, place[wanted[one]], 1 / len(wanted[one]))
            counted += 1
    return int(np.searchsorted(np.cumsum(reached), min(recall * counted, reached.sum()) - 1e-9) + 1) if counted else 1
