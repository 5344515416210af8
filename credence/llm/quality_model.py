"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

The grades are 0 (low quality), 1 (good but toxic) and 2 (good). One vector of
weights over hashed text features is shared by all grades and ordered
thresholds separate them: P(grade <= k) = logistic(t_k - w x). The expected
grade and the tail probability P(grade >= 2) come from that; the latter
selects.

Features of a document are the distinct words (letters and digits, lower
case) and their beginnings, what hangs on words (leading and trailing signs,
all capitals), and classes of length and of repetition, each hashed into
`DIMENSIONS`. The model is fitted on at most `SAMPLE` labels, those with the
smallest hashes of their ids. Tasks make their features and count them by grade.
Features whose likelihood ratio (signed root of G squared) between the top grade
and the others is under `LEAST_G` are left out, so that a few telling words are
not drowned in a long document; only the telling features of the sample come to
the driver, which maximises the penalised likelihood by limited-memory BFGS.
Every document is scored where it lies.

Defined results for unusual input: a null or empty text has only the length
class; a very long text is read whole; labels that are null, or whose document is
missing, are not used; a document labelled more than once counts once for each
label; of documents that repeat a labelled id the one with the smallest hash is
used, so that reruns agree; labels that tie at the sample's end are alike but for
their grade, and the lower grade goes first; with fewer than two grades among the
labels all grades are null and everything is kept; repeated rows give repeated
rows; null ids are kept; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 20_000
DIMENSIONS = 1 << 18
GRADES = 3
LEAST_G = 4.0
ROUNDS, PENALTY, SETTLED, MEMORY = 200, 1e-4, 1e-5, 10
STARTS = (4, 5)
LEAST_TAIL = 0.5
_CACHE = 200_000


def _number(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature) % DIMENSIONS


class WordFeatures(dict):
    """Numbers of the features of a word, kept for words seen lately."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _CACHE:
            self.clear()
        core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…»«“”")
        out = [_number(b"w" + core.lower().encode())] if core else []
        out += [_number(b"b" + core[:n].lower().encode()) for n in STARTS if len(core) > n]
        head, _, tail = word.partition(core) if core else ("", "", word)
        out += [_number(k + v.encode()) for k, v in ((b"h", head), (b"t", tail)) if v]
        if len(core) > 1 and core.isupper():
            out.append(_number(b"capitals"))
        value = self[word] = tuple(out)
        return value


def features(text: str | None, known: WordFeatures) -> np.ndarray:
    found = (text or "").split()
    distinct = set(found)
    out = set().union(*map(known.__getitem__, distinct))
    out.add(_number(b"length%d" % len(found).bit_length()))
    if found:
        out.add(_number(b"distinct%d" % (8 * len(distinct) // len(found))))
    return np.fromiter(out, np.int32, len(out))


def telling(with_top: np.ndarray, with_other: np.ndarray, n_top: int, n: int) -> np.ndarray:
    """Which features tell the top grade from the others, by how many rows of either have them."""
    both = with_top + with_other
    parts = ((with_top, both * n_top / n), (with_other, both * (n - n_top) / n), (n_top - with_top, (n - both) * n_top / n), (n - n_top - with_other, (n - both) * (n - n_top) / n))
    g = 2 * sum(seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)) for seen, expected in parts)
    return (both > 0) & (g >= LEAST_G**2)


class Likelihood:
    """The cost, minus the mean log-likelihood with a penalty on the weights, and its gradient. Parameters are the weights, the first threshold and the logarithms of the steps to the next, so that thresholds stay in order."""

    def __init__(self, rows: list[np.ndarray], grades: np.ndarray, features: int):
        self.index = np.concatenate(rows) if rows else np.empty(0, np.int32)
        self.of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        self.grades, self.features, self.one = grades, features, np.arange(len(grades))

    def start(self) -> np.ndarray:
        share = np.cumsum(np.bincount(self.grades, minlength=GRADES)[:-1] + 1) / (len(self.grades) + GRADES)
        cuts = np.log(share / (1 - share))
        return np.concatenate([np.zeros(self.features), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1))])

    def split(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, thresholds)"""
        return p[: self.features], p[self.features] + np.append(0, np.cumsum(np.exp(p[self.features + 1 :])))

    def __call__(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        w, cuts = self.split(p)
        n, one, grades = len(self.grades), self.one, self.grades
        s = np.bincount(self.of, weights=w[self.index], minlength=n)
        below = np.column_stack([np.zeros(n), 1 / (1 + np.exp(np.clip(s[:, None] - cuts[None, :], -40, 40))), np.ones(n)])
        slope = below * (1 - below)
        likely = np.maximum(below[one, grades + 1] - below[one, grades], 1e-12)
        # d log P / d threshold, for the one above the grade and the one below it
        above, under = slope[one, grades + 1] / likely, slope[one, grades] / likely
        by_cut = np.array([above[grades == j].sum() - under[grades == j + 1].sum() for j in range(GRADES - 1)]) / n
        by_s = (under - above) / n
        by_w = np.bincount(self.index, weights=by_s[self.of], minlength=self.features) - PENALTY * w
        by_step = np.exp(p[self.features + 1 :]) * np.cumsum(by_cut[::-1])[::-1][1:]
        cost = PENALTY / 2 * (w @ w) - np.log(likely).mean()
        return float(cost), -np.concatenate([by_w, [by_cut.sum()], by_step])


def descend(cost, p: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The minimum of a smooth function that returns (value, gradient), by limited-memory BFGS with a halving line search."""
    value, g = cost(p)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max(initial=0) < SETTLED:
            break
        d, back = g.copy(), []
        for move, turn in reversed(moves):
            a = (move @ d) / (move @ turn)
            back.append(a)
            d -= a * turn
        d *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.linalg.norm(g))
        for (move, turn), a in zip(moves, reversed(back)):
            d += (a - (turn @ d) / (move @ turn)) * move
        step, fall = 1.0, g @ d
        while True:
            new, new_g = cost(p - step * d)
            if new <= value - 1e-4 * step * fall:
                break
            step /= 2
            if step < 1e-10:
                return p
        move, turn = -step * d, new_g - g
        p, value, g = p + move, new, new_g
        if move @ turn > 1e-12:
            moves = [*moves, (move, turn)][-MEMORY:]
    return p


def graded(labels: DataFrame) -> DataFrame:
    """(id, grade) from quality and toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("id"), grade.alias("grade"))


def labelled(docs: DataFrame, grades: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(label, grade, x): the features, as bytes of int32, of the sample's labels; written."""
    chosen = grades.orderBy(F.xxhash64("id"), "grade").limit(sample)
    chosen = F.broadcast(materialize(chosen.withColumn("label", F.monotonically_increasing_id()), "labels"))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(chosen, F.col("doc") == F.col("id")).select("label", "grade", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([features(t.as_py(), known).tobytes() for t in batch.column(3)], pa.binary())], names=["label", "grade", "h", "x"])

    found = rows.mapInArrow(run, "label long, grade int, h long, x binary")
    return materialize(found.groupBy("label", "grade").agg(F.min_by("x", "h").alias("x")), "labelled")


def train(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
    """(weights, thresholds) from at most `sample` graded rows (id, grade), or None."""
    rows = labelled(docs, grades, id_col, text_col, sample)
    by_grade = {r.grade: r["count"] for r in rows.groupBy("grade").count().collect()}
    if len(by_grade) < 2:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, DIMENSIONS), np.int64)
        for batch in batches:
            for grade, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                np.add.at(seen[int(grade == GRADES - 1)], np.frombuffer(x.as_py(), np.int32), 1)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1][at]), pa.array(seen[0][at])], names=["f", "top", "other"])

    counted = rows.select("grade", "x").mapInArrow(count, "f long, top long, other long").groupBy("f").agg(F.sum("top").alias("top"), F.sum("other").alias("other")).toArrow()  # at most DIMENSIONS rows
    at, with_top, with_other = (counted.column(k).to_numpy() for k in range(3))
    top = by_grade.get(GRADES - 1, 0)
    used = np.sort(at[telling(with_top, with_other, top, sum(by_grade.values()))])
    place = np.full(DIMENSIONS, -1, np.int32)
    place[used] = np.arange(len(used))
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = (sent.value[np.frombuffer(x.as_py(), np.int32)] for x in batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([np.sort(k[k >= 0]).tobytes() for k in kept], pa.binary())], names=["label", "grade", "x"])

    got = rows.mapInArrow(keep, "label long, grade int, x binary").toArrow().sort_by("label")  # at most `sample` rows
    likelihood = Likelihood([np.frombuffer(x.as_py(), np.int32) for x in got.column("x")], got.column("grade").to_numpy(), len(used))
    w, cuts = likelihood.split(descend(likelihood, likelihood.start()))
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return weights, cuts


def score(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least_tail: float = LEAST_TAIL) -> DataFrame:
    """doc_id, expected_grade, p_good (P(grade >= 1)), p_clean (P(grade >= 2)), kept for every row of docs."""
    model = train(docs, grades, id_col, text_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", none.alias("expected_grade"), none.alias("p_good"), none.alias("p_clean"), F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = sent.value
        known = WordFeatures()
        for batch in batches:
            s = np.array([weights[x].sum(dtype=np.float64) for x in (features(t.as_py(), known) for t in batch.column(1))])
            tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - s[:, None], -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tail.sum(axis=1)), pa.array(tail[:, 0]), pa.array(tail[:, 1]), pa.array(tail[:, 1] >= least_tail)], names=["doc_id", "expected_grade", "p_good", "p_clean", "kept"])

    return rows.mapInArrow(run, "doc_id long, expected_grade double, p_good double, p_clean double, kept boolean")
