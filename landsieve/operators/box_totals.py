"""Totals of what a polygon meets, without listing the pairs.

Two boxes share no point exactly if one ends before the other starts on some axis. So the number of boxes met is a sum
of four counts of points to the lower left of a point, and so is the total of their values. Such a count is taken in
three parts: points in the same strip of x, points in the same strip of y but an earlier strip of x, and the cells of a
grid of strips that lie before both. Strips hold about as many rows each, and are worked on one by one in Arrow batches.
Polygons that are no boxes are joined pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsieve.operators.spatial import intersecting
from landsieve.session import materialize, ship_package

#: Strips of each axis at most, and rows a strip should have at least.
STRIPS, STRIP_ROWS = 256, 20_000
BOX = ("xmin", "ymin", "xmax", "ymax")


def is_box() -> Column:
    """Whether a polygon (bbox, edges) is the whole box around it."""
    b, edges = F.col("bbox"), F.col("edges")
    known = ~(F.isnan(b["xmax"]) | F.isnan(b["ymax"])) & (b["xmax"] > b["xmin"]) & (b["ymax"] > b["ymin"])
    side = F.forall(edges, lambda e: ((e["x1"] == e["x2"]) != (e["y1"] == e["y2"])) & e["x1"].isin(b["xmin"], b["xmax"]) & e["y1"].isin(b["ymin"], b["ymax"]))
    corners = F.array_distinct(F.transform(edges, lambda e: F.struct(e["x1"], e["y1"])))
    return F.coalesce(known & (F.size(edges) == 4) & side & (F.size(corners) == 4), F.lit(False))


def dominated(px: np.ndarray, py: np.ndarray, value: np.ndarray, qx: np.ndarray, qy: np.ndarray,
              x_equal: bool, y_equal: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each query the number of points before it on both axes, and the total of their values.

    Points in order of x are parted by the bits of their rank in y, from the highest on; all queries go down together.
    """
    by_x, by_y = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
    rank = np.empty(len(py), np.int64)
    rank[by_y] = np.arange(len(py))
    rank, value = rank[by_x], value[by_x]
    hi = np.searchsorted(px[by_x], qx, "right" if x_equal else "left")
    upto = np.searchsorted(py[by_y], qy, "right" if y_equal else "left")
    lo, n, total = np.zeros_like(hi), np.zeros(len(qx), np.int64), np.zeros(len(qx), np.int64)
    for bit in range(len(px).bit_length() - 1, -1, -1):
        low = (rank >> bit) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(low)])
        sums = np.concatenate([[0], np.cumsum(np.where(low, value, 0))])
        z_lo, z_hi, up = zeros[lo], zeros[hi], (upto >> bit) & 1 == 1
        n += np.where(up, z_hi - z_lo, 0)
        total += np.where(up, sums[hi] - sums[lo], 0)
        lo, hi = np.where(up, zeros[-1] + lo - z_lo, z_lo), np.where(up, zeros[-1] + hi - z_hi, z_hi)
        order = np.concatenate([np.flatnonzero(low), np.flatnonzero(~low)])
        rank, value = rank[order], value[order]
    return n, total


def _strips(batch: pa.RecordBatch, xs: np.ndarray, ys: np.ndarray) -> tuple[dict, dict]:
    """Sides of the boxes of a batch, and the strips they lie in."""
    at = {n: batch.column(k).to_numpy() for k, n in enumerate(BOX)}
    return at, {n: np.searchsorted(xs if n[0] == "x" else ys, v, "right") for n, v in at.items()}


def box_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, n, total) of the boxes ``left`` (xmin .. ymax, id) over the boxes ``right`` (xmin .. ymax, value), zeros too."""
    spark = left.sparkSession
    ends = left.select(*BOX).unionByName(right.select(*BOX)).select(
        F.explode(F.array(F.struct(F.col("xmin").alias("x"), F.col("ymin").alias("y")), F.struct(F.col("xmax").alias("x"), F.col("ymax").alias("y")))).alias("p")).select("p.*")
    strips = int(min(STRIPS, max(1, left.count() // STRIP_ROWS)))
    cuts = [k / strips for k in range(1, strips)]
    xs, ys = (np.unique(q) for q in ends.approxQuantile(["x", "y"], cuts, 1 / (4 * strips))) if cuts else (np.zeros(0), np.zeros(0))
    wide, tall = len(xs) + 1, len(ys) + 1
    ship_package(spark)

    def cells(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(4 * wide * tall, np.int64), np.zeros(4 * wide * tall, np.int64)
        for batch in source:
            _, strip = _strips(batch, xs, ys)
            for k, (x, y) in enumerate((x, y) for x in ("xmin", "xmax") for y in ("ymin", "ymax")):
                cell = (k * wide + strip[x]) * tall + strip[y]
                np.add.at(n, cell, 1)
                np.add.at(total, cell, batch.column(4).to_numpy())
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), pa.array(total[met])], names=["cell", "n", "total"])

    grid = np.zeros((2, 4, wide, tall), np.int64)
    found = right.mapInArrow(cells, "cell long, n long, total long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    grid.reshape(2, -1)[:, found["cell"].to_numpy()] = np.stack([found["n"].to_numpy(), found["total"].to_numpy()])
    # what lies before a cell on both axes
    before = np.zeros((2, 4, wide + 1, tall + 1), np.int64)
    before[:, :, 1:, 1:] = grid.cumsum(2).cumsum(3)
    shared = spark.sparkContext.broadcast(before)
    names = ["strip", "asks", "a", "b1", "b2", "id", "n", "total"]

    def dealt(query: bool):
        x_of, y_of = (("xmax", "xmin"), ("ymax", "ymin")) if query else (("xmin", "xmax"), ("ymin", "ymax"))

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                at, strip = _strips(batch, xs, ys)
                nothing = np.zeros(batch.num_rows, np.int64)
                known = [nothing, nothing]
                if query:
                    known = [sum(sign * part[k][strip[x], strip[y]] for k, (sign, x, y) in enumerate(
                        [(1, "xmax", "ymax"), (-1, "xmax", "ymin"), (-1, "xmin", "ymax"), (1, "xmin", "ymin")])) for part in shared.value]
                for side in range(4):
                    own = x_of[side] if side < 2 else y_of[side - 2]
                    cross = [at[y] for y in y_of] if side < 2 else [strip[x].astype(float) for x in x_of]
                    cols = [strip[own] * 4 + side, np.full(batch.num_rows, query), at[own], *cross, batch.column(4).to_numpy(),
                            *(known if side == 0 else [nothing, nothing])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        return run

    def settled(rows: pa.Table) -> pa.Table:
        side, asks = rows["strip"][0].as_py() % 4, rows["asks"].to_numpy()
        col = {n: rows[n].to_numpy() for n in names[2:]}
        p, q = {n: v[~asks] for n, v in col.items()}, {n: v[asks] for n, v in col.items()}
        n, total = q["n"].copy(), q["total"].copy()
        for sign, b in ((1, "b1"), (-1, "b2")):
            sign = sign if side % 2 == 0 else -sign
            more = dominated(p["a"], p[b], p["id"], q["a"], q[b], side % 2 == 0, side < 2 and b == "b1")
            n += sign * more[0]
            total += sign * more[1]
        return pa.table({"id": q["id"], "n": n, "total": total})

    ddl = "strip long, asks boolean, a double, b1 double, b2 double, id long, n long, total long"
    rows = left.mapInArrow(dealt(True), ddl).unionByName(right.mapInArrow(dealt(False), ddl))
    return rows.groupBy("strip").applyInArrow(settled, "id long, n long, total long").groupBy("id").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))


def meeting_totals(left: DataFrame, right: DataFrame, cell: float, value: str, left_id: str = "id", right_id: str = "id") -> DataFrame:
    """(left_id, n, total): how many right polygons share a point with each left one, and the total of their ``value``.

    Ids and values are whole numbers. Polygons that meet none are left out.
    """
    b = F.col("bbox")
    # written first: edges are derived once, not once for each time the test of a box names them
    a, o = (materialize(df.select(*dict.fromkeys([*c, "bbox", "edges", "anchors"])), name, deal=True).withColumn("_box", is_box())
            for df, name, c in ((left, "left-polygons", [left_id]), (right, "right-polygons", [right_id, value])))
    cols = lambda df, c: df.filter("_box").select(*[b[n].alias(n) for n in BOX], F.col(c).cast("long").alias("id"))
    boxes = materialize(cols(a, left_id), "left-boxes")
    out = box_totals(boxes, materialize(cols(o, value), "right-boxes")).select(F.col("id").alias(left_id), "n", "total")
    listed = [(a.filter("not _box"), o), (a.filter("_box"), o.filter("not _box"))]
    for some, others in listed:
        if not (some.isEmpty() or others.isEmpty()):
            pairs = intersecting(some.drop("_box"), others.drop("_box"), cell, left_id, right_id)
            out = out.unionByName(pairs.groupBy(left_id).agg(F.count("*").alias("n"), F.sum(f"r_{value}").alias("total")))
    return out.groupBy(left_id).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0")
