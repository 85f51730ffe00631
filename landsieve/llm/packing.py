"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity`` ids. Pieces are dealt into groups of bounded size; each
group is packed by best-fit decreasing, and dual feasible functions give a lower bound for its number of bins.
A group that meets its bound is proven optimal. Groups with a gap give the documents of their unfilled bins to
a pool, which is dealt into new groups and packed again; a round counts only if it needs fewer bins.

Defined results: a null text is an empty one (its sequence is the end id alone); repeated rows and null ids are
documents of their own; an empty table gives no pieces; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsieve.llm.common import batches, map_batches, row_numbers, texts, written
from landsieve.llm.encode import encoder

PIECE = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                   ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_DDL = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_DDL = PIECE_DDL + ", bin int, offset long, filled long, gap int"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first, which takes what is over."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece of each document (doc_id, text), with the CRC of its ids."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = encoder(tokenizer), row_numbers()

        def rows():
            for batch in source:
                for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    ids = np.array([*encode(text), end_id], dtype="<u4")
                    for k, (start, n) in enumerate(cut(len(ids), capacity)):
                        yield next(uid), doc, k, start, n, zlib.crc32(ids[start:start + n].tobytes())

        yield from batches(rows(), PIECE)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECE_DDL)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin.

    A bit mask of the rooms that some open bin has gives the tightest one that holds an item in one step.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, room_of = 0, []
    for i in order.tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(room_of), capacity
            room_of.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room_of[b] = left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, capacity - np.array(room_of, dtype=np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    Threshold t: sizes over capacity - t count as a whole bin, sizes under t as nothing, others as they are.
    Rounding k: a size x counts floor((k + 1) x / capacity) / k, or x / capacity where (k + 1) x divides evenly.
    """
    if not len(sizes):
        return 0
    have = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    count, total = np.cumsum(have), np.cumsum(have * size)
    t = np.arange(capacity // 2 + 1)
    below = np.maximum(t - 1, 0)
    value = (count[-1] - count[capacity - t]) * capacity + total[capacity - t] - np.where(t > 0, total[below], 0)
    best = int(-(-value.max() // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * size
        even = scaled % capacity == 0
        # k * capacity is the common denominator of both cases
        worth = np.where(even, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((worth * have).sum()) // (k * capacity)))
    return best


def _packed(pieces: DataFrame, groups: int, capacity: int, turn: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        sizes = group["length"].to_numpy()
        bins, offsets, filled = best_fit_decreasing(sizes, capacity)
        gap = len(filled) - lower_bound(sizes, capacity)
        out = group.drop_columns(["grp"])
        for name, col in (("bin", pa.array(bins, pa.int32())), ("offset", pa.array(offsets, pa.int64())),
                          ("filled", pa.array(filled[bins], pa.int64())),
                          ("gap", pa.array(np.full(len(sizes), gap), pa.int32()))):
            out = out.append_column(name, col)
        return out.append_column("grp", group["grp"])

    keyed = pieces.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
    done = keyed.groupBy("grp").applyInArrow(run, PACKED_DDL + ", grp long")
    return done.withColumn("sequence_id", F.lit(turn << 56) + F.col("grp") * F.lit(1 << 20) + F.col("bin"))


def pack(pieces: DataFrame, capacity: int, group_items: int = 8192, rounds: int = 4) -> DataFrame:
    """Sequence and offset of every piece.

    ``group_items`` bounds what one task packs at once, so the number of groups grows with the input. Work on
    the pool ends when no group has a gap, when one group holds the whole pool, or after ``rounds`` rounds.
    """
    out_cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = pieces.filter(F.col("length") >= capacity).select(
        *out_cols[:5], (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool, done = pieces.filter(F.col("length") < capacity), []
    held, before = pool.count(), None
    for turn in range(rounds):
        groups = max(1, -(-held // group_items))
        now = written(_packed(pool, groups, capacity, turn), "packed")
        n_bins = now.select("sequence_id").distinct().count()
        if before is not None and n_bins >= before[1]:
            break
        if before is not None:
            done[-1] = done[-1].filter(~before[0])
        done.append(now)
        loose = (F.col("gap") > 0) & (F.col("filled") < capacity)
        held, used = now.filter(loose).agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
        if not held or groups == 1:
            break
        before, pool = (loose, used), now.filter(loose).select(*PIECE.names)
    for part in done:
        whole = whole.unionByName(part.select(*out_cols))
    return whole


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
                   group_items: int = 8192, rounds: int = 4) -> DataFrame:
    """Pieces of all documents with their place in as few sequences as the method finds."""
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(pieces, capacity, group_items, rounds)
