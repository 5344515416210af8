"""MinHash near-dedup with odd sketches.

Documents are sets of 64-bit hashes of five-word shingles. Equal sets are one
class, found by a 128-bit digest; from here on a class is its smallest id. A
class has 120 MinHash samples, in 24 bands of 5 (a pair at similarity 0.85
shares no band once in a million), and an odd sketch: each sample flips one of
512 bits, so the XOR of two sketches counts the samples in which they differ,
and its population count estimates high similarities closely. Candidates share
a band; those whose sketches are within `MARGIN` of the threshold are confirmed
on their full sets.

Groups of near copies are not expanded into pairs. First every member of a
bucket is held against one leader, which costs a comparison for each
membership; what links is one component. Members that are still in different
components are compared by sketch, in blocks of a bucket so that a large bucket
is many small tasks; what comes out is no more than a spanning forest over the
components that come near each other. Each tree of it is a group, and its
members' texts meet in blocks of the group, where pairs of near sketches are
confirmed, nearest first, unless links found before already join them. Of the
two blocks that meet, one holds no member of the bucket's or group's main
component, so that a large component is not compared with itself. No bucket
and no group is capped.

With a leader, confirmation sorts the texts of the leader and of its partners
next to each other and streams them, holding one set at a time; a leader with
many partners is repeated for every `PARTNERS` of them.

Defined results for unusual input: a null text, or one without words, has no
shingles and is linked with nothing; with fewer than five words the whole
sequence is the one shingle; very long texts are read whole, and one with very
many shingles fills a block of its own; a null id is linked with nothing; rows
that repeat an id are one document, which is linked with what any of its texts
is linked with, and stay or go together; an empty table gives an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_hot, materialize
from .components import components

WIDTH = 5
THRESHOLD = 85
BANDS, ROWS, BITS = 24, 5, 512
MARGIN = 0.2
BLOCK, PARTNERS = 256, 64
BLOCK_SHINGLES = 100_000
_CACHE = 200_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None]
_ODD = (_rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1))[:, None]


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text in UTF-8. bytes.lower and bytes.split know A-Z and the six white characters only, as is asked for."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(width, len(w))
    h = w[: len(w) - k + 1].copy()
    for j in range(1, k):
        h = h * _STEP + w[j : len(w) - k + 1 + j]
    return np.unique(_mixed(h + np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        least = np.minimum(least, ((s[None, at : at + 4096] ^ _XOR) * _ODD).min(axis=1))
    return least


def sketched(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches, for the samples of many sets at once."""
    number = np.arange(BANDS * ROWS, dtype=np.uint64)
    at = _mixed(sig + number * _STEP) % np.uint64(BITS)
    flips = np.zeros((len(sig), BITS), np.uint8)
    np.add.at(flips, (np.arange(len(sig))[:, None], at.astype(np.int64)), 1)
    sketch = np.packbits(flips & 1, axis=1).view(np.uint64)
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = _mixed(key * _STEP + parts[:, :, r])
    return key, sketch


def most_bits(threshold: int = THRESHOLD, margin: float = MARGIN) -> int:
    """The most differing bits of two sketches that are looked at further."""
    differing = 2 * BANDS * ROWS * (1 - (threshold / 100 - margin))
    return int(np.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** differing)))


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(a).reshape(-1).view(np.int64)))


def sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n, digest (null for an empty set), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, digests, sigs = [], [], np.zeros((batch.num_rows, BANDS * ROWS), np.uint64)
            for i, text in enumerate(batch.column(1)):
                s = shingles(text.as_py(), hashes, width)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    sigs[i] = signature(s)
            keys, sketch = sketched(sigs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), _lists(keys), _lists(sketch)], names=["doc_id", "n", "digest", "bands", "sketch"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, digest binary, bands array<long>, sketch array<long>")


def _bits(a: Column, b: Column) -> Column:
    return sum(F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64))


def _alike(n: Column, m: Column, threshold: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * threshold


def _similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both * 100 >= (len(a) + len(b) - both) * threshold


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough. docs: doc_id, text (binary). Partners of the same b are read next to it."""
    pairs = materialize(pairs, "candidates")
    counts = pairs.groupBy("b").agg(F.count("*").alias("c")).select(F.col("b").alias("_b"), "c", F.ceil(F.col("c") / PARTNERS).alias("_chunks"))
    counts = materialize(counts, "partners")
    joined = pairs.join(F.broadcast(counts), F.col("b") == F.col("_b")) if counts.count() <= BROADCAST_ROWS else join_hot(pairs, counts, "b", "_b", "c")
    dealt = joined.select("a", "b", F.pmod(F.xxhash64("a"), F.col("_chunks")).alias("chunk"))
    dealt = materialize(dealt, "pairs")
    wanted = dealt.select(F.col("a").alias("id"), "b", "chunk", F.lit(1).alias("role")).union(dealt.select(F.col("b").alias("id"), "b", "chunk", F.lit(0).alias("role")).distinct())
    wanted = materialize(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = docs.join(wanted, F.col("doc_id") == F.col("id")).select("b", "chunk", "role", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, heads, at = WordHashes(), [], None
        for batch in batches:
            a, b = [], []
            for hub, chunk, role, one, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                s = shingles(text.as_py(), hashes, width)
                if role == 0:  # a leader has more than one text where its id is repeated
                    heads, at = [*heads, s] if at == (hub, chunk) else [s], (hub, chunk)
                elif at == (hub, chunk) and any(_similar(s, head, threshold) for head in heads):
                    a.append(one)
                    b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("b", "chunk").sortWithinPartitions("b", "chunk", "role").select("b", "chunk", "role", "id", "text").mapInArrow(run, "a long, b long")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (rep, ...) with label: the component so far."""
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("_node"), "root")
    return members.join(roots, F.col("rep") == F.col("_node"), "left").withColumn("label", F.coalesce("root", "rep")).drop("_node", "root")


def _with_leader(reps: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs (a, b): members of a bucket and its leader, the smallest."""
    members = reps.select("rep", F.explode("bands").alias("key"))
    leaders = members.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("c")).filter("c > 1").select(F.col("key").alias("_key"), "leader", "c")
    leaders = materialize(leaders, "leaders")
    pairs = join_hot(members, leaders, "key", "_key", "c").filter(F.col("rep") != F.col("leader")).select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = materialize(pairs, "led")
    followers = pairs.groupBy("b").agg(F.count("*").alias("c"))
    left, right = (reps.select(F.col("rep").alias(f"_{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    right = materialize(followers.join(right, F.col("b") == F.col("_b")).drop("b"), "leader-sketches")
    pairs = join_hot(pairs, right, "b", "_b", "c").join(left, F.col("a") == F.col("_a"))
    return pairs.filter(_alike(F.col("na"), F.col("nb"), threshold) & (_bits(F.col("sa"), F.col("sb")) <= most_bits(threshold))).select("a", "b")


def _in_blocks(members: DataFrame, main: Column, minor_blocks: Column, main_blocks: Column) -> DataFrame:
    """members (rep, ...) with own, their block, and i <= j, once for each two blocks that meet there. Blocks of the main component follow the others and do not meet each other."""
    hashed = F.xxhash64("rep")
    dealt = members.withColumn("_main", main).withColumn("_m", minor_blocks.cast("int")).withColumn("_n", main_blocks.cast("int"))
    own = F.when(F.col("_main"), F.col("_m") + F.pmod(hashed, F.col("_n"))).otherwise(F.pmod(hashed, F.col("_m"))).cast("int")
    last = F.when(F.col("_main"), F.col("_m")).otherwise(F.col("_m") + F.col("_n")) - 1
    dealt = dealt.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_main", "_m", "_n", "_other")


def _near_pairs(across: bool, own: np.ndarray, label: np.ndarray, n: np.ndarray, sketch: np.ndarray, threshold: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of the pairs of different components whose sizes and sketches are near enough, nearest first."""
    x, y = np.triu_indices(len(label), 1)
    use = label[x] != label[y]
    if across:
        use &= own[x] != own[y]
    x, y = x[use], y[use]
    use = np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * threshold
    x, y = x[use], y[use]
    apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
    order = np.argsort(apart, kind="stable")
    order = order[apart[order] <= limit]
    return x[order], y[order]


class _Joined(dict):
    """Components within a group."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, x: int, y: int) -> None:
        self[self.root(x)] = self.root(y)


_MEMBER = ("own", "rep", "label", "n", "sketch")


def _runs(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """work(across, columns) for each run of rows with equal first three columns (group, i, j); columns are those of _MEMBER, then whatever follows as a list. It returns pairs (a, b). One run is held at a time."""
    at, held = None, []

    def done() -> list[tuple[int, int]]:
        columns = [np.concatenate([h[k] for h in held]) for k in range(5)]
        return work(at[1] != at[2], *columns, *([x for h in held for x in h[k]] for k in range(5, len(held[0])))) if len(columns[0]) > 1 else []

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
        plain = [batch.column(3 + k).to_numpy() for k in range(4)]
        plain.append(batch.column(7).flatten().to_numpy().reshape(batch.num_rows, -1))
        rest = [batch.column(k) for k in range(8, batch.num_columns)]
        found: list[tuple[int, int]] = []
        ends = [*(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        begin = 0
        for end in ends:
            key = tuple(keys[:, begin].tolist())
            if key != at:
                if held:
                    found += done()
                at, held = key, []
            held.append([c[begin:end] for c in plain] + [work.prepare(c.slice(begin, end - begin)) for c in rest])
            begin = end
        yield _pairs(found)
    if held:
        yield _pairs(done())


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(f[k]) for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


class _Forest:
    """A spanning forest, over components, of the pairs with near sketches."""

    def __init__(self, threshold: int, limit: int):
        self.threshold, self.limit = threshold, limit

    def __call__(self, across, own, rep, label, n, sketch) -> list[tuple[int, int]]:
        x, y = _near_pairs(across, own, label, n, sketch, self.threshold, self.limit)
        joined, out = _Joined(), []
        for a, b in zip(label[x].tolist(), label[y].tolist()):
            if joined.root(a) != joined.root(b):
                joined.join(a, b)
                out.append((a, b))
        return out


class _Links:
    """Confirmed links between components; pairs that links found before join are not looked at."""

    def __init__(self, threshold: int, limit: int, width: int):
        self.threshold, self.limit, self.width, self.hashes = threshold, limit, width, WordHashes()

    def prepare(self, texts: pa.Array) -> list[np.ndarray]:
        return [shingles(t.as_py(), self.hashes, self.width) for t in texts]

    def __call__(self, across, own, rep, label, n, sketch, full) -> list[tuple[int, int]]:
        x, y = _near_pairs(across, own, label, n, sketch, self.threshold, self.limit)
        joined, out = _Joined(), []
        for a, b in zip(x.tolist(), y.tolist()):
            if joined.root(label[a]) != joined.root(label[b]) and _similar(full[a], full[b], self.threshold):
                joined.join(label[a], label[b])
                out.append((rep[a], rep[b]))
        return out


def _groups(reps: DataFrame, threshold: int) -> DataFrame:
    """(label, group) of the components that come near another one, as their sketches have it."""
    work = _Forest(threshold, most_bits(threshold))
    members = reps.select("rep", "label", F.explode("bands").alias("key"))
    main = F.min_by("label", "rep")
    mixed = members.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("l"), F.max("label").alias("m"), main.alias("main")).filter("l < m").select(F.col("key").alias("_key"), "c", F.col("c").alias("_times"), F.col("main").alias("_main_label"))
    inside = join_hot(members, materialize(mixed, "mixed"), "key", "_key", "_times").select("rep", "label", "key", "c", "_main_label")
    blocks = F.ceil(F.col("c") / BLOCK)
    dealt = _in_blocks(inside, F.col("label") == F.col("_main_label"), blocks, blocks).select("key", "i", "j", "own", "rep", "label")
    full = dealt.join(reps.select(F.col("rep").alias("_rep"), "n", "sketch"), F.col("rep") == F.col("_rep")).select("key", "i", "j", *_MEMBER)
    near = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda batches: _runs(batches, work), "a long, b long")
    roots = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return roots.select(F.col("node").alias("label"), F.col("root").alias("group")).union(roots.select(F.col("root").alias("label"), F.col("root").alias("group")).distinct())


def _between(reps: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """The links (a, b) that join the components of reps which belong together."""
    work = _Links(threshold, most_bits(threshold), width)
    groups = materialize(_groups(reps, threshold), "groups").withColumnRenamed("label", "_label")
    inside = materialize(reps.join(groups, F.col("label") == F.col("_label")).select("group", "rep", "label", "n", "sketch"), "grouped")
    parts = inside.groupBy("group", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = parts.groupBy("group").agg(F.max(F.struct("c", "s", "label")).alias("x"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    needed = lambda c, s: F.greatest(F.lit(1), F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select(F.col("group").alias("_group"), F.col("x.label").alias("_main_label"), needed(F.col("c") - F.col("x.c"), F.col("s") - F.col("x.s")).alias("_minor"), needed(F.col("x.c"), F.col("x.s")).alias("_main_n"))
    inside = inside.join(sizes, F.col("group") == F.col("_group"))
    dealt = _in_blocks(inside, F.col("label") == F.col("_main_label"), F.col("_minor"), F.col("_main_n")).select("group", "i", "j", *_MEMBER)
    dealt = materialize(dealt, "blocks")
    dealt = F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS // 4 else dealt
    rows = docs.join(dealt, F.col("doc_id") == F.col("rep")).select("group", "i", "j", *_MEMBER, "text")
    return rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(lambda batches: _runs(batches, work), "a long, b long")


def _same_id(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of ids that stand on rows with different sets."""
    h = F.xxhash64("digest")
    repeated = found.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(h).alias("x"), F.max(h).alias("y")).filter("x < y").select(F.col("doc_id").alias("_id"))
    rows = found.join(repeated, F.col("doc_id") == F.col("_id")).select("doc_id", "digest")
    return rows.join(classes.select(F.col("digest").alias("_d"), "rep"), F.col("digest") == F.col("_d")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of df."""
    found = materialize(sets(df, id_col, text_col, width), "sets")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    classes = found.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    reps = classes.select("rep", "n", "bands", "sketch")
    links = materialize(confirmed(_with_leader(reps, threshold), docs, threshold, width), "links")
    joined = materialize(_labelled(reps, links), "labelled")
    links = links.union(materialize(_between(joined, docs, threshold, width), "links")).union(materialize(_same_id(found, classes), "links"))
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    of_class = classes.select("digest", "rep", "copies").join(roots, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("_d"), F.coalesce("root", "rep").alias("component_id"), ((F.col("copies") > 1) | F.col("root").isNotNull()).alias("_more")).filter("_more")
    out = found.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(of_class.drop("_more"), F.col("digest") == F.col("_d"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of df whose document is the smallest of its component, and those without an id."""
    gone = near_duplicates(df, id_col, text_col, **how).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    gone = materialize(gone, "duplicates")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return df.join(gone, df[id_col] == gone["_gone"], "left_anti")
