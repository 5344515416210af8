"""Best-fit packing with bound-certified repacking.

Documents are tokenised where they lie and cut into pieces of at most one
sequence; only lengths travel after that. Pieces that fill a sequence stand
alone. The others are dealt by hash into partitions of bounded size, each
packed by best-fit decreasing and held against a lower bound from
dual-feasible functions: a partition whose number of bins meets the bound is
certified and done. Partitions with a gap keep the bins that are full to the
last token and give the rest of their documents back; these are dealt anew,
among fewer partitions, and packed again, until every partition is certified,
one partition is left, or a round no longer lowers the number of partitions.

Documents can have a place in training order (`in_order`: that of the rows in
their files). Then the first round's partitions are windows of `WINDOW` documents
in a row, and each further round joins two neighbours, so that all documents of
a sequence come from the same `WINDOW * 2 ** (ORDERED_ROUNDS - 1)` places; the
place of its first document tells when a sequence is due.

Defined results for unusual input: a null or empty text is the closing id
alone; a very long text is cut into whole sequences after its first piece; of
equal lengths the one that was read first is packed first; repeated rows are
packed as often as they occur; an empty table gives an empty result; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, small

CAPACITY = 2048
END = 0
PIECES_PER_PARTITION = 2000
MAX_ROUNDS = 8
WINDOW, ORDERED_ROUNDS = 2000, 4
#: Dual-feasible functions tried: rounding with k = 1.. this, and all thresholds of the Martello-Toth family.
ROUNDINGS = 100

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, place long"
_loaded: dict = {}


def encoder(vocabulary: bytes, ranks: bytes, pattern: str):
    """A function from texts to arrays of ids.

    The ids are those of the `tokenizers` vocabulary; the same vocabulary as `tiktoken` ranks gives them about five times faster, and `tokenizers` itself steps in for a text that the former refuses.
    """
    key = (zlib.crc32(vocabulary), zlib.crc32(ranks))
    if key not in _loaded:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_str(vocabulary.decode())
        special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        fast = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except Exception:  # a text beyond the regular expression engine's stack
                return np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        _loaded[key] = encode
    return _loaded[key]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole sequences, after a first piece that has the rest."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pieces(df: DataFrame, vocabulary: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, place_col: str | None = None) -> DataFrame:
    """uid (unique once written), doc_id, piece, start, length, ids_crc32 and place (null without place_col) of every piece. vocabulary and ranks are files on the driver."""
    files = df.sparkSession.sparkContext.broadcast((Path(vocabulary).read_bytes(), Path(ranks).read_bytes(), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files.value)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, text, place in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = np.append(encode(text.as_py() or ""), end).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((uid, doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), place))
                    uid += 1
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=schema.names), schema=schema, preserve_index=False)

    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("place", pa.int64())])
    place = F.lit(None).cast("long") if place_col is None else F.col(place_col)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), place.alias("place")).mapInArrow(run, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each length, and the room left in each bin.

    Open bins are kept by the room they have left; a bit mask of the rooms in use finds the tightest that suffices.
    """
    order = np.argsort(-lengths, kind="stable")
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, left = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room = room - n
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.asarray(left, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound on the number of bins that the dual-feasible functions give."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    value = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * value).sum()) // capacity)
    many, total = np.append(np.cumsum(count[::-1])[::-1], 0), np.append(np.cumsum((count * value)[::-1])[::-1], 0)
    # Items above capacity - a count whole, those below a not at all, the others by size.
    a = np.arange(0, capacity // 2 + 1)
    top = capacity - a + 1
    whole, between = many[top], np.maximum(total[a] - total[top], 0)
    best = max(best, int((whole - (-between // capacity)).max()))
    # The same with the middle items that share a bin with no other such item counted apart.
    half = capacity // 2 + 1
    alone, room = many[half] - many[top], (many[half] - many[top]) * capacity - (total[half] - total[top])
    small = total[a] - total[half]
    best = max(best, int((whole + alone + np.maximum(0, -((room - small) // capacity))).max()))
    k = np.arange(1, ROUNDINGS + 1)[:, None]
    scaled, rest = np.divmod((k + 1) * value[None, :], capacity)
    # In units of 1 / (k capacity): x itself where (k + 1) x is whole, else floor((k + 1) x) / k.
    weight = np.where(rest == 0, value[None, :] * k, scaled * capacity)
    sums = (weight * count[None, :]).sum(axis=1)
    return max(best, int((-(-sums // (k[:, 0] * capacity))).max()))


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
    lengths = pdf["length"].to_numpy()
    bins, offsets, left = best_fit(lengths, capacity)
    gap = len(left) - lower_bound(lengths, capacity)
    first = np.full(len(left), np.iinfo(np.int64).max)
    np.minimum.at(first, bins, pdf["uid"].to_numpy())
    out = pdf.drop(columns="part").assign(sequence_id=first[bins], offset=offsets, done=(left[bins] == 0) | (gap == 0))
    if "place" in out:
        out["sequence_place"] = out.groupby(bins)["place"].transform("min")
    return out


def _packed(pool: DataFrame, part: Column, capacity: int, name: str) -> DataFrame:
    """pool (uid, length, more) with sequence_id, offset and done, packed part by part."""
    dealt = pool.withColumn("part", part)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema.fields) + ", sequence_id long, offset long, done boolean"
    return materialize(dealt.groupBy("part").applyInPandas(lambda pdf: _pack_group(pdf, capacity), schema + (", sequence_place long" if "place" in pool.columns else "")), name)


def assign_in_order(lengths: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, rounds: int = ORDERED_ROUNDS) -> DataFrame:
    """uid, sequence_id, offset, sequence_place for a table of (uid, length, place); sequences stay within window * 2^(rounds - 1) places. A document has at most one piece that is no whole sequence, so a window is a bounded task."""
    done = lengths.filter(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("place").alias("sequence_place"))
    pool = lengths.filter(F.col("length") < capacity).select("uid", "length", "place")
    for k in range(rounds):
        packed = _packed(pool, F.floor(F.col("place") / (window << k)), capacity, f"packed-{k}")
        done = done.union((packed if k == rounds - 1 else packed.filter("done")).select("uid", "sequence_id", "offset", "sequence_place"))
        pool = packed.filter(~F.col("done")).select("uid", "length", "place")
        if not pool.limit(1).count():
            break
    return done


def places(df: DataFrame, column: str) -> DataFrame | None:
    """df, read from files, with the place of each row in the order of file names and of rows in them; None if df is not read from files. Only a count for each file is looked at."""
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return None
    counts = materialize(placed.groupBy("_file").count(), "files")
    before = counts.select(F.col("_file").alias("_f"), (F.sum("count").over(Window.orderBy(F.length("_file"), "_file")) - F.col("count")).alias("_before"))
    before = F.broadcast(before) if counts.count() <= BROADCAST_ROWS else before
    return placed.join(before, F.col("_file") == F.col("_f")).withColumn(column, F.col("_before") + F.col("_at")).drop("_file", "_f", "_at", "_before")


def assign(lengths: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """uid, sequence_id, offset for a table of (uid, length); a sequence is named by its smallest uid."""
    spark = lengths.sparkSession
    done = lengths.filter(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = lengths.filter(F.col("length") < capacity).select("uid", "length")
    count, parts = pool.count(), None
    for k in range(max_rounds):
        before, parts = parts, max(1, -(-count // per_partition))
        if not count:
            break
        last = parts == 1 or k == max_rounds - 1 or (before is not None and parts >= before)
        packed = _packed(pool, F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(parts)), capacity, f"packed-{k}")
        done = done.union((packed if last else packed.filter("done")).select("uid", "sequence_id", "offset"))
        if last:
            break
        pool = packed.filter(~F.col("done")).select("uid", "length")
        count = pool.count()
    return done


def pack(df: DataFrame, vocabulary: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, in_order: bool = False, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; in order also sequence_place, the place of the first document of the piece's sequence (null where df is not read from files, as there is no order then)."""
    placed = places(df.select(id_col, text_col), "_place") if in_order else None
    given = df if placed is None else placed
    found = materialize(pieces(given, vocabulary, ranks, pattern, id_col, text_col, capacity, end, None if placed is None else "_place"), "pieces")
    if placed is None:
        assigned = assign(found.select("uid", "length"), capacity, **how).withColumn("sequence_place", F.lit(None).cast("long"))
    else:
        assigned = assign_in_order(found.select("uid", "length", "place"), capacity, **how)
    # One row a piece: where they are few, pieces stay in the files they were written to, and no file is made for each shuffle partition.
    joined = found.join(F.broadcast(assigned) if small(found) else assigned, "uid")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["sequence_place"] if in_order else []))
