"""Union of polygons that may overlap, each point counted once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsieve.functions import geometry as G
from landsieve.session import ship_package

TRAPEZOID = ("y0", "y1", "left0", "right0", "left1", "right1")


def cell_union(es: np.ndarray, owner: np.ndarray, box: tuple[float, float, float, float]) -> list[tuple[float, ...]]:
    """Trapezoids (y0, y1, left0, right0, left1, right1) of the union of polygons inside a box.

    ``es`` has the polygons' edges as rows x1, y1, x2, y2, ``owner`` the number of the polygon each belongs to. Heights at which
    an edge ends, crosses another or leaves the box cut it into strips; in a strip the edges keep their order, so its
    covered stretches are found by walking them left to right, each turning its polygon on or off.
    """
    xmin, ymin, xmax, ymax = box
    rising = es[:, 1] != es[:, 3]
    es, owner = es[rising], owner[rising]
    down = es[:, 1] > es[:, 3]
    es[down] = es[down][:, [2, 3, 0, 1]]
    used = (es[:, 1] < ymax) & (es[:, 3] > ymin) & (np.minimum(es[:, 0], es[:, 2]) < xmax)
    es, owner = es[used], owner[used]
    if not len(es):
        return []
    slope = (es[:, 2] - es[:, 0]) / (es[:, 3] - es[:, 1])
    heights = [es[:, 1], es[:, 3], np.array([ymin, ymax])]
    with np.errstate(divide="ignore", invalid="ignore"):
        for x in (xmin, xmax):
            heights.append(es[:, 1] + (x - es[:, 0]) / slope)
        # edges cross where their x is the same; only crossings inside both count
        at0 = es[:, 0] - slope * es[:, 1]
        for i in range(len(es)):
            y = (at0[i] - at0[i + 1:]) / (slope[i + 1:] - slope[i])
            low, high = np.maximum(es[i, 1], es[i + 1:, 1]), np.minimum(es[i, 3], es[i + 1:, 3])
            heights.append(y[(y > low) & (y < high)])
    ys = np.concatenate(heights)
    ys = np.unique(ys[(ys >= ymin) & (ys <= ymax)])
    out = []
    for y0, y1 in zip(ys, ys[1:], strict=False):
        k = np.flatnonzero((es[:, 1] <= y0) & (es[:, 3] >= y1))
        mid = (y0 + y1) / 2
        k = k[np.argsort(es[k, 0] + slope[k] * (mid - es[k, 1]), kind="stable")]
        inside: set[int] = set()
        start = None
        for e in k.tolist():
            inside ^= {int(owner[e])}
            if start is None and inside:
                start = e
            elif start is not None and not inside:
                sides = [float(np.clip(es[s, 0] + slope[s] * (y - es[s, 1]), xmin, xmax)) for y in (y0, y1) for s in (start, e)]
                if sides[1] > sides[0] or sides[3] > sides[2]:
                    out.append((float(y0), float(y1), *sides))
                start = None
        if start is not None:
            # its far side lies past the box
            sides = [float(np.clip(es[start, 0] + slope[start] * (y - es[start, 1]), xmin, xmax)) for y in (y0, y1)]
            if min(sides) < xmax:
                out.append((float(y0), float(y1), sides[0], xmax, sides[1], xmax))
    return out


def boundary_union(polygons: DataFrame, group: str, cell: float) -> DataFrame:
    """Parts of the union of each group's polygons (bbox, edges): group, ring, area.

    The plane is cut into cells of width ``cell``, and each cell of a group is settled on its own by trapezoids that
    don't overlap, so no group is gone through by one task. Equal polygons count once, and a cell gets only those
    edges of a polygon that lie beside or left of it.
    """
    b, size = F.col("bbox"), F.lit(float(cell))
    name = polygons.schema[group]
    cells = F.flatten(F.transform(F.sequence(F.floor(b["xmin"] / size), F.floor(b["xmax"] / size)), lambda x: F.transform(
        F.sequence(F.floor(b["ymin"] / size), F.floor(b["ymax"] / size)), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    low, high, right = F.col("c.cy") * size, (F.col("c.cy") + 1) * size, (F.col("c.cx") + 1) * size
    near = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) > low) & (F.least(e["y1"], e["y2"]) < high) & (F.least(e["x1"], e["x2"]) < right))
    shares = (
        polygons.select(group, "bbox", "edges").dropDuplicates([group, "edges"]).withColumn("c", F.explode(cells))
        .select(group, "c.cx", "c.cy", near.alias("edges")).filter(F.size("edges") > 0))

    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        lists = rows["edges"].combine_chunks()
        flat = lists.flatten()
        es = np.stack([flat.field(n).to_numpy() for n in ("x1", "y1", "x2", "y2")], axis=1)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        cx, cy = key[1].as_py(), key[2].as_py()
        found = cell_union(es, owner, (cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell))
        cols = [pa.array(c, pa.float64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.float64())] * 6
        return pa.table([pa.array([key[0].as_py()] * len(found), rows[group].type), *cols], names=[group, *TRAPEZOID])

    ship_package(polygons.sparkSession)
    ddl = f"`{group}` {name.dataType.simpleString()}, " + ", ".join(f"{n} double" for n in TRAPEZOID)
    parts = shares.groupBy(group, "cx", "cy").applyInArrow(settle, ddl)
    col = F.col
    ring = F.array(G.point(col("left0"), col("y0")), G.point(col("right0"), col("y0")), G.point(col("right1"), col("y1")),
                   G.point(col("left1"), col("y1")), G.point(col("left0"), col("y0")))
    area = (col("right0") - col("left0") + col("right1") - col("left1")) / 2.0 * (col("y1") - col("y0"))
    return parts.select(group, ring.alias("ring"), area.alias("area"))
