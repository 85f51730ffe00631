"""Hard-negative mining with exact scores from Kronecker-packed products.

Candidates are dealt into blocks, labels kept together as far as a block holds them. In a block the components of
several candidates are biased to be non-negative and put into separated fields of one wide integer; one product with
an anchor's component then serves all of them, and after the last component the fields are read out: each score
comes back exactly, as every field is wide enough for the largest sum that can stand in it.

Two passes: an anchor meets the blocks that may hold its own label for its positives, then all blocks for rows of
other labels whose score lies in the window of each positive. A candidate is not repeated by anchors: these go to the
blocks, and only past ANCHORS of them does a block serve a second group.

Defined results: rows without id or label, without a vector, or with a null or non-finite component take no part;
repeated rows count once; rows of one id with different labels or vectors are rows of their own, and none of them is
a partner of another; a shorter vector counts as padded with zeros, an empty one has score 0; components and scores
past a long are cut to its range; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landsieve.llm.common import written
from landsieve.session import ship_package

#: Rows of a candidate block, anchors that one block serves at once, anchors multiplied together.
CANDIDATES, ANCHORS, TILE = 8192, 131_072, 32
#: Labels are hashed into no more bins than this; a bin past one block is dealt over several.
BINS = 4096
LONG = 2**63 - 1
#: Fields of one integer where a score needs more than a machine word.
WIDE_FIELDS = 8


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


class PackedBlock:
    """Candidates (rows of ``x``) packed for products with anchors whose components sum to at most ``reach`` in size."""

    def __init__(self, x: np.ndarray, reach: int):
        self.n, low = len(x), int(x.min(initial=0))
        self.bias = -low
        self.offset = reach * (int(x.max(initial=0)) - low)
        self.width = max(1, (2 * self.offset).bit_length())
        machine = self.width <= 64
        self.fields = 64 // self.width if machine else WIDE_FIELDS
        kind = np.uint64 if machine else object
        groups = -(-self.n // self.fields)
        padded = np.zeros((groups * self.fields, x.shape[1]), np.int64)
        padded[:self.n] = x
        # a field past the last candidate holds the bias alone
        shifted = padded.astype(object) + self.bias if not machine else (padded + self.bias).astype(np.uint64)
        self.columns = np.zeros((x.shape[1], groups), kind)
        for f in range(self.fields):
            self.columns += shifted[f::self.fields].T << kind(f * self.width) if machine else shifted[f::self.fields].T * (1 << f * self.width)
        self.ones = sum(1 << f * self.width for f in range(self.fields))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner product of every anchor (row) with every candidate."""
        machine = self.columns.dtype != object
        # a machine word wraps around, and the sum of all fields fits it: negative factors need no care
        a = anchors.astype(np.int64).view(np.uint64) if machine else anchors.astype(object)
        total = np.full((len(a), self.columns.shape[1]), self.offset * self.ones, self.columns.dtype)
        step = np.empty_like(total)
        for j in range(a.shape[1]):
            np.multiply(a[:, j, None], self.columns[j], out=step)
            total += step
        out = np.empty((len(a), total.shape[1] * self.fields), np.int64 if machine else object)
        mask = (1 << self.width) - 1
        taken = anchors.sum(axis=1) * self.bias + self.offset if machine else a.sum(axis=1) * self.bias + self.offset
        for f in range(self.fields):
            if machine:
                field = (total >> np.uint64(f * self.width)) & np.uint64(mask)
                out[:, f::self.fields] = field.view(np.int64) - taken[:, None]
            else:
                out[:, f::self.fields] = ((total // (1 << f * self.width)) % (mask + 1)) - taken[:, None]
        out = out[:, :self.n]
        return out if machine else np.clip(out, -LONG, LONG).astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.flatten().to_numpy().reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat.flatten().to_numpy()
    return out


def _reach(a: np.ndarray) -> int:
    """The largest sum of component sizes over the anchors, as a whole number of any size."""
    if not a.size:
        return 0
    exact = a.astype(object) if max(abs(int(a.min())), abs(int(a.max()))) > 2**50 else a
    return int(np.abs(exact).sum(axis=1).max())


def best_of_label(a: np.ndarray, a_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> Iterator[tuple]:
    """(anchor row, candidate row, score) of each anchor's k best candidates of another id; x by ascending id."""
    block = PackedBlock(x, _reach(a))
    for start in range(0, len(a), TILE):
        s = block.scores(a[start:start + TILE])
        other = x_ids[None, :] != a_ids[start:start + TILE, None]
        s = np.where(other, s, -LONG - 1)
        kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -LONG - 1)
        # all scores at or above the kth stay in, so that the id settles ties
        row, col = np.nonzero((s >= kth[:, None]) & other)
        order = np.lexsort((col, -s[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        for r, c in zip(row[place < k].tolist(), col[place < k].tolist(), strict=True):
            yield start + r, c, int(s[r, c])


def in_windows(a: np.ndarray, a_labels: np.ndarray, windows: list, x: np.ndarray, x_labels: np.ndarray,
               n: int) -> Iterator[tuple]:
    """(anchor row, window number, candidate row, score) of the n best candidates of another label in each window.

    ``windows`` holds for each anchor its (number, least score, greatest score), none of them empty.
    """
    block = PackedBlock(x, _reach(a))
    for start in range(0, len(a), TILE):
        s, mine = block.scores(a[start:start + TILE]), windows[start:start + TILE]
        low = np.array([min(w[1] for w in ws) for ws in mine])
        high = np.array([max(w[2] for w in ws) for ws in mine])
        fits = (s >= low[:, None]) & (s <= high[:, None]) & (x_labels[None, :] != a_labels[start:start + TILE, None])
        for r, ws in enumerate(mine):
            col = np.flatnonzero(fits[r])
            down = -s[r, col]
            order = np.lexsort((col, down))
            col, down = col[order], down[order]
            for number, least, greatest in ws:
                first = int(np.searchsorted(down, -greatest, "left"))
                for c, v in zip(col[first:first + n].tolist(), down[first:first + n].tolist(), strict=True):
                    if -v >= least:
                        yield start + r, number, c, -v


def _windows(scores: list[int], low: int, high: int) -> list[tuple[int, int, int]]:
    """(number, least, greatest) whole score with low * p <= 100 * s <= high * p for each positive's score p."""
    found = [(i, -(-low * p // 100), high * p // 100) for i, p in enumerate(scores)]
    return [w for w in found if w[1] <= w[2]]


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame, int, Column]:
    """Rows with their block, bins (bin, first, chunks; at most BINS rows), number of blocks, bin of a label."""
    bins = max(1, min(BINS, -(-rows.count() // CANDIDATES)))
    bin_of = F.pmod(F.xxhash64("label"), F.lit(bins)).cast("int")
    binned = rows.withColumn("bin", bin_of)
    first, places = 0, []
    for b, n in sorted(tuple(r) for r in binned.groupBy("bin").count().collect()):
        chunks = -(-n // CANDIDATES)
        places.append((b, first, chunks))
        first += chunks
    table = rows.sparkSession.createDataFrame(places, "bin int, first int, chunks int")
    block = F.col("first") + F.pmod(F.xxhash64("id", "z"), F.col("chunks")).cast("int")
    return binned.join(F.broadcast(table), "bin").withColumn("block", block).drop("first", "chunks"), table, first, bin_of


def _meet(anchors: DataFrame, blocks: DataFrame, parts: int, run, ddl: str) -> DataFrame:
    """``run(anchors, candidates)`` for each block and each part of the anchors sent to it."""
    ship_package(blocks.sparkSession)
    part = F.pmod(F.xxhash64("uid", "id"), F.lit(parts)).cast("int")
    a = anchors.withColumn("part", part)
    x = blocks.select("block", "id", "label", "z").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return a.groupBy("block", "part").cogroup(x.groupBy("block", "part")).applyInArrow(run, ddl)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The first ``negatives`` rows of other labels for each anchor and each of its first ``positives`` of the same.

    ``rows`` and ``anchors``: id, label, z (longs), uid (tells rows of one id apart). A negative's score lies between
    ``low`` and ``high`` percent of the positive's.
    """
    blocks, bins, n_blocks, bin_of = _dealt(rows)
    blocks, anchors = written(blocks, "blocks"), written(anchors.withColumn("bin", bin_of), "anchors")
    parts = max(1, -(-anchors.count() // ANCHORS))
    pos_schema = pa.schema([("anchor_id", pa.int64()), ("uid", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])
    neg_schema = pa.schema([("anchor_id", pa.int64()), ("uid", pa.int64()), ("number", pa.int32()), ("negative_id", pa.int64()),
                            ("score", pa.int64())])

    def widths(*tables: pa.Table) -> int:
        return max(1, *[int(np.diff(c.offsets.to_numpy()).max(initial=0)) for t in tables for c in t["z"].chunks])

    def find_positives(a: pa.Table, x: pa.Table) -> pa.Table:
        if not a.num_rows or not x.num_rows:
            return pos_schema.empty_table()
        x, width = x.sort_by([("label", "ascending"), ("id", "ascending")]), widths(a, x)
        a = a.sort_by("label")
        am, xm, a_label, x_label = _matrix(a["z"], width), _matrix(x["z"], width), a["label"].to_numpy(), x["label"].to_numpy()
        a_ids, x_ids, uids, out = a["id"].to_numpy(), x["id"].to_numpy(), a["uid"].to_numpy(), []
        for label in np.unique(a_label):
            i, j = (slice(*np.searchsorted(v, [label, label + 1])) if label < LONG else v == label for v in (a_label, x_label))
            if len(x_ids[j]):
                out += [(a_ids[i][r], uids[i][r], x_ids[j][c], s)
                        for r, c, s in best_of_label(am[i], a_ids[i], xm[j], x_ids[j], positives)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), pos_schema, strict=True)] if out else
                        [pa.array([], f.type) for f in pos_schema], schema=pos_schema)

    def find_negatives(a: pa.Table, x: pa.Table) -> pa.Table:
        windows = [_windows(p, low, high) for p in a["positives"].to_pylist()]
        some = [i for i, w in enumerate(windows) if w]
        if not some or not x.num_rows:
            return neg_schema.empty_table()
        a, x = a.take(some), x.sort_by("id")
        width = widths(a, x)
        a_ids, uids, x_ids = a["id"].to_numpy(), a["uid"].to_numpy(), x["id"].to_numpy()
        out = [(a_ids[r], uids[r], number, x_ids[c], s) for r, number, c, s in in_windows(
            _matrix(a["z"], width), a["label"].to_numpy(), [windows[i] for i in some], _matrix(x["z"], width),
            x["label"].to_numpy(), negatives) if a_ids[r] != x_ids[c]]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), neg_schema, strict=True)] if out else
                        [pa.array([], f.type) for f in neg_schema], schema=neg_schema)

    to_own = anchors.join(F.broadcast(bins), "bin").withColumn(
        "block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("chunks") - 1)))
    near = _meet(to_own.select("block", "id", "uid", "label", "z"), blocks, parts, find_positives,
                 "anchor_id long, uid long, positive_id long, score long")
    best = Window.partitionBy("anchor_id", "uid").orderBy(F.desc("score"), "positive_id")
    pairs = written(near.withColumn("number", F.row_number().over(best) - 1).filter(F.col("number") < positives), "positives")
    lists = pairs.groupBy("anchor_id", "uid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "score"))), lambda p: p["score"]).alias("positives"))
    known = anchors.join(lists, (F.col("id") == F.col("anchor_id")) & (anchors["uid"] == lists["uid"])).select(
        "id", anchors["uid"], "label", "z", "positives")
    to_all = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks, 1) - 1))))
    found = _meet(to_all, blocks, parts, find_negatives, "anchor_id long, uid long, number int, negative_id long, score long")
    order = Window.partitionBy("anchor_id", "uid", "number").orderBy(F.desc("score"), "negative_id")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return first.withColumnRenamed("score", "negative_score").join(
        pairs.withColumnRenamed("score", "positive_score"), ["anchor_id", "uid", "number"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``; labels of every seventh id are moved on first."""
    label = F.col("label").cast("long")
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        quantised(F.col("embedding"), scale).alias("z")).distinct()
    rows = written(rows.withColumn("uid", F.xxhash64("id", "label", "z")), "vectors")
    return hard_negatives(rows, rows.filter(F.col("id") % every == 0), positives, negatives, low, high)
