"""Large polygons cut once into cell fragments, so that a pair test reads one cell's edges.

A polygon of many edges is divided like a quadtree, sixteen cells at a time, until a cell holds few edges. What is
left are pieces of two kinds: cells that the boundary passes, with the edges that touch them, and cells wholly inside,
with none. A piece also says whether one reference point in it lies inside the polygon; from there, any point of the
cell is settled by the edges of that cell alone, since crossing one of them changes sides. Edges stay as they are, so
what two edges have in common is tested on the coordinates given.

Small polygons are one piece, their reference point lying outside the box.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from landsieve.functions import geometry as G
from landsieve.session import materialize, ship_package

#: Edges that a piece may hold without being divided, cells to a side of a division, and how often it is repeated.
MAX_EDGES, SIDE, DEEPEST = 48, 4, 12
#: Divisions in a row that part off less than a tenth of the edges, after which a cell stays one piece.
STALE = 6
#: Where the reference point lies in its cell: a place that data on round grids doesn't have.
REF_X, REF_Y = 0.41421356237, 0.73205080757
BOX, EDGE, POINT = ("xmin", "ymin", "xmax", "ymax"), ("x1", "y1", "x2", "y2"), ("x", "y")


def _ref_outside(b: Column) -> Column:
    w, h = b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]
    return F.struct((b["xmax"] + F.lit(REF_X) * (w + h) + F.lit(1e-9)).alias("x"), (b["ymax"] + F.lit(REF_Y) * (w + h) + F.lit(1e-9)).alias("y"),
                    F.lit(False).alias("inside"))


def _between(x: Column, y: Column, px: Column, py: Column, e: Column) -> Column:
    """Whether an edge lies between two points.

    A vertex counts as left of the way between them or as right of it, the same for both edges it ends.
    """
    def left(vx, vy):
        return (px - x) * (vy - y) - (py - y) * (vx - x) >= 0

    def ahead(qx, qy):
        return (e["x2"] - e["x1"]) * (qy - e["y1"]) - (e["y2"] - e["y1"]) * (qx - e["x1"]) >= 0

    return (left(e["x1"], e["y1"]) != left(e["x2"], e["y2"])) & (ahead(x, y) != ahead(px, py))


def inside_from(ref: Column, px: Column, py: Column, es: Column) -> Column:
    """Whether a point is inside, given the side of ``ref`` and all edges between the two."""
    return F.aggregate(es, ref["inside"], lambda acc, e: acc != _between(ref["x"], ref["y"], px, py, e))


def touches_box(e: Column, b: Column) -> Column:
    """Whether an edge touches a closed box; one that passes a corner within rounding counts as touching."""
    cx, cy = (b["xmin"] + b["xmax"]) / 2.0, (b["ymin"] + b["ymax"]) / 2.0
    hx, hy = (b["xmax"] - b["xmin"]) / 2.0, (b["ymax"] - b["ymin"]) / 2.0
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    reach = F.abs(dx) * hy + F.abs(dy) * hx
    return (
        (F.least(e["x1"], e["x2"]) <= b["xmax"]) & (F.greatest(e["x1"], e["x2"]) >= b["xmin"])
        & (F.least(e["y1"], e["y2"]) <= b["ymax"]) & (F.greatest(e["y1"], e["y2"]) >= b["ymin"])
        & (F.abs(dx * (cy - e["y1"]) - dy * (cx - e["x1"])) <= reach * (1 + 1e-9)))


def large(polygons: DataFrame, max_edges: int = MAX_EDGES) -> Column:
    """Whether a polygon is worth dividing: many edges, and a box with area."""
    b = F.col("bbox")
    return (F.size("edges") > max_edges) & (b["xmax"] > b["xmin"]) & (b["ymax"] > b["ymin"])


def large(polygons: DataFrame, max_edges: int = MAX_EDGES) -> Column:
    """Whether a polygon is worth dividing: many edges, and a box with area."""
    b = F.col("bbox")
    return (F.size("edges") > max_edges) & (b["xmax"] > b["xmin"]) & (b["ymax"] > b["ymin"])


def _divided(cells: DataFrame) -> DataFrame:
    """The cells that ``cells`` (_pid, _path, bbox, ref, n, stale, items) are divided into.

    Edges and anchors are rows here, each tried against the sixteen cells of a division. What decides a cell's
    reference point, whether an odd number of edges lies between it and its parent's, is added up with them.
    """
    b, ref, it, k = F.col("bbox"), F.col("ref"), F.col("it"), F.col("k")

    def cut(lo, hi, i):
        # neighbours share their borders exactly
        return F.when(i == SIDE, hi).otherwise(lo + (hi - lo) * (i / F.lit(float(SIDE))))

    i, j = F.floor(k / SIDE), k % SIDE
    kid = F.struct(cut(b["xmin"], b["xmax"], i).alias("xmin"), cut(b["ymin"], b["ymax"], j).alias("ymin"),
                   cut(b["xmin"], b["xmax"], i + 1).alias("xmax"), cut(b["ymin"], b["ymax"], j + 1).alias("ymax"))
    rows = (
        cells.withColumn("it", F.explode("items")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))))
        .select("_pid", (F.col("_path") * (SIDE * SIDE) + k).alias("_path"), "bbox", "ref", "n", "stale", "it", kid.alias("c")))
    c = F.col("c")
    x, y = c["xmin"] + (c["xmax"] - c["xmin"]) * F.lit(REF_X), c["ymin"] + (c["ymax"] - c["ymin"]) * F.lit(REF_Y)

    def owns(v, lo, hi):
        return (it[v] >= c[lo]) & ((it[v] < c[hi]) | ((it[v] == c[hi]) & (c[hi] == b[hi])))

    hit = F.when(it["anchor"], owns("x1", "xmin", "xmax") & owns("y1", "ymin", "ymax")).otherwise(touches_box(it, c))
    odd = (~it["anchor"] & _between(ref["x"], ref["y"], x, y, it)).cast("int")
    keys = ["_pid", "_path"]
    kids = rows.select(*keys, "n", "stale", F.struct(c.alias("bbox"), x.alias("x"), y.alias("y"), ref["inside"].alias("inside")).alias("own"),
                       odd.alias("odd")).groupBy(*keys).agg(
        F.bit_xor("odd").alias("odd"), F.first("own").alias("own"), F.first("n").alias("of"), F.first("stale").alias("stale"))
    held = rows.filter(hit).groupBy(*keys).agg(F.count_if(~it["anchor"]).alias("n"), F.collect_list("it").alias("items"))
    own, n = F.col("own"), F.coalesce("n", F.lit(0))
    inside = own["inside"] != (F.col("odd") == 1)
    return kids.join(held, keys, "left").filter((n > 0) | inside).select(
        *keys, own["bbox"].alias("bbox"), F.struct(own["x"].alias("x"), own["y"].alias("y"), inside.alias("inside")).alias("ref"),
        n.alias("n"), F.when(n >= F.col("of") * 0.9, F.col("stale") + 1).otherwise(F.lit(0)).alias("stale"),
        F.coalesce("items", F.array().cast(ITEMS_T)).alias("items"))


def divide(box: np.ndarray, es: np.ndarray, anchors: np.ndarray, ref: tuple[float, float, bool],
           max_edges: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float, bool]]]:
    """(box, numbers of edges, numbers of anchors, reference point) of the pieces of one polygon."""
    i, j = np.divmod(np.arange(SIDE * SIDE), SIDE)
    todo = [(box, np.arange(len(es)), np.arange(len(anchors)), ref, 0, 0)]
    while todo:
        b, mine, points, (rx, ry, inside), depth, stale = todo.pop()
        # neighbours share their borders exactly
        xs, ys = (np.append(b[k] + (b[k + 2] - b[k]) * (np.arange(SIDE) / SIDE), b[k + 2]) for k in (0, 1))
        kids = np.stack([xs[i], ys[j], xs[i + 1], ys[j + 1]], axis=1)
        x0, y0, x1, y1 = (kids[:, k, None] for k in range(4))
        ax, ay, bx, by = es[mine].T
        dx, dy, px, py = bx - ax, by - ay, x0 + (x1 - x0) * REF_X, y0 + (y1 - y0) * REF_Y
        off = np.abs(dx * ((y0 + y1) / 2 - ay) - dy * ((x0 + x1) / 2 - ax))
        hit = ((np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
               & (off <= (np.abs(dx) * (y1 - y0) + np.abs(dy) * (x1 - x0)) / 2 * (1 + 1e-9)))
        left = lambda vx, vy: (px - rx) * (vy - ry) - (py - ry) * (vx - rx) >= 0
        ahead = lambda qx, qy: dx * (qy - ay) - dy * (qx - ax) >= 0
        within = inside ^ (((left(ax, ay) != left(bx, by)) & (ahead(rx, ry) != ahead(px, py))).sum(axis=1) % 2 == 1)
        vx, vy = anchors[points].T
        own = ((vx >= x0) & ((vx < x1) | ((vx == x1) & (x1 == b[2]))) & (vy >= y0) & ((vy < y1) | ((vy == y1) & (y1 == b[3]))))
        for k in np.flatnonzero(hit.any(axis=1) | within):
            some, at, point = mine[hit[k]], points[own[k]], (float(px[k, 0]), float(py[k, 0]), bool(within[k]))
            idle = stale + 1 if len(some) >= 0.9 * len(mine) else 0
            if len(some) > max_edges and idle < STALE and depth + 1 < DEEPEST:
                todo.append((kids[k], some, at, point, depth + 1, idle))
            else:
                yield kids[k], some, at, point


def _structs(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and members, one row each, of a column of lists of structs."""
    flat = column.flatten()
    fields = [flat.field(n).to_numpy(zero_copy_only=False) for n in names]
    sizes = np.array([len(x) if x is not None else 0 for x in column.to_pylist()]) if column.null_count else np.diff(column.offsets.to_numpy())
    return np.concatenate([[0], np.cumsum(sizes)]), np.stack(fields, axis=1) if len(flat) else np.zeros((0, len(names)))


def _listed(lists: list[np.ndarray], names: tuple[str, ...], kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
    flat = np.concatenate(lists) if lists else np.zeros((0, len(names)))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(len(names))], fields=list(kind.value_type)))


def _cut(batch: pa.RecordBatch, out: pa.Schema, max_edges: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch of large polygons, some hundreds at a time."""
    box = np.stack([batch["bbox"].field(n).to_numpy(zero_copy_only=False) for n in BOX], axis=1)
    e_at, es = _structs(batch["edges"], EDGE)
    a_at, an = _structs(batch["anchors"], POINT)
    refs = batch["ref"].to_pylist()

    def found():
        for r in range(batch.num_rows):
            own_es, own_an = es[e_at[r]:e_at[r + 1]], an[a_at[r]:a_at[r + 1]]
            ref = tuple(refs[r][n] for n in ("x", "y", "inside"))
            for b, some, at, point in divide(box[r], own_es, own_an, ref, max_edges):
                yield r, b, own_es[some], own_an[at], point

    rows = found()
    while held := list(itertools.islice(rows, 512)):
        number, boxes, edges, points, ref = zip(*held, strict=True)
        boxes = np.array(boxes)
        made = {"bbox": pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(boxes[:, k])) for k in range(4)],
                                                   fields=list(out.field("bbox").type)),
                "edges": _listed(edges, EDGE, out.field("edges").type), "anchors": _listed(points, POINT, out.field("anchors").type),
                "ref": pa.StructArray.from_arrays([pa.array(v) for v in zip(*ref, strict=True)], fields=list(out.field("ref").type))}
        yield pa.RecordBatch.from_arrays([made[n] if n in made else batch[n].take(pa.array(number)) for n in out.names], schema=out)


def one_piece(polygons: DataFrame) -> DataFrame:
    """Polygons as one piece each, whatever their size."""
    return polygons.withColumn("ref", _ref_outside(F.col("bbox")))


def pieces(polygons: DataFrame, max_edges: int = MAX_EDGES) -> tuple[DataFrame, bool]:
    """Pieces of polygons (bbox, edges, anchors and other columns), and whether any polygon was divided.

    A piece has the polygon's other columns, its own bbox, edges and anchors, and ``ref``. Pieces without edges lie
    wholly inside. Only large polygons leave the JVM, each divided where its row is; the pieces are written once.
    """
    whole = one_piece(polygons)
    if polygons.filter(large(polygons, max_edges)).isEmpty():
        return whole, False
    out = to_arrow_schema(whole.schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(batch.num_rows):
                yield from _cut(batch.slice(at, 1), out, max_edges)

    ship_package(polygons.sparkSession)
    cut = materialize(whole.filter(large(polygons, max_edges)).mapInArrow(run, whole.schema), "fragments", deal=True)
    return whole.filter(~F.coalesce(large(polygons, max_edges), F.lit(False))).unionByName(cut), True


def _in_box(p: Column, b: Column) -> Column:
    return p["x"].between(b["xmin"], b["xmax"]) & p["y"].between(b["ymin"], b["ymax"])


def pieces_intersect(a: str = "", b: str = "r_") -> Column:
    """Whether the polygons of two pieces with overlapping boxes share a point that these pieces can show.

    Between all pieces of two polygons with a common point, one pair shows it: edges that touch, an edge in a cell
    wholly inside, or a vertex of one inside the other.
    """
    col = lambda p, c: F.col(f"{p}{c}")
    solid_a, solid_b = F.size(col(a, "edges")) == 0, F.size(col(b, "edges")) == 0

    def enters(p, o):
        return F.exists(col(p, "edges"), lambda e: touches_box(e, col(o, "bbox")))

    def holds(p, o):
        return F.exists(col(o, "anchors"), lambda v: _in_box(v, col(p, "bbox")) & inside_from(col(p, "ref"), v["x"], v["y"], col(p, "edges")))

    return (
        F.when(solid_a & solid_b, F.lit(True)).when(solid_a, enters(b, a)).when(solid_b, enters(a, b))
        .otherwise(holds(a, b) | holds(b, a) | F.exists(
            col(a, "edges"), lambda e: touches_box(e, col(b, "bbox")) & F.exists(col(b, "edges"), lambda o: G.segments_touch(e, o)))))


def piece_contains(px: Column, py: Column, prefix: str, strict: bool) -> Column:
    """Whether a point in a piece's box lies in its polygon; on the boundary only if not ``strict``."""
    es = F.col(f"{prefix}edges")
    inside, on = inside_from(F.col(f"{prefix}ref"), px, py, es), G.on_edge(px, py, es)
    return inside & ~on if strict else inside | on


#: Cells to a side that a piece's box is seen in.
COVER_SIDE = 8


def cover_cells(cut: DataFrame) -> DataFrame:
    """The grid cells that pieces meet, one row each: ``lv``, ``cx``, ``cy``, and ``full`` where a cell lies wholly inside.

    A piece is seen at the level (cell side 2 ** lv) where its box spans four to eight cells, so there are at most 81
    for each. A full cell and a rim of a millionth around it hold no boundary, so rounding can't put a point of it outside.
    Boxes without width and height have no cells.
    """
    b, size = F.col("bbox"), F.pow(F.lit(2.0), F.col("lv"))
    extent = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    lv = F.greatest(F.least(F.ceil(F.log2(extent / F.lit(float(COVER_SIDE)))), F.lit(30)), F.lit(-30)).cast("int")

    def spans(lo, hi):
        rim = size * F.lit(1e-6)
        return F.explode(F.transform(F.sequence(F.floor(lo / size), F.floor(hi / size)), lambda i: F.struct(
            i.alias("i"), (i * size - rim).alias("lo"), ((i + 1) * size + rim).alias("hi"))))

    x, y = F.col("_x"), F.col("_y")
    c = {"xmin": x["lo"], "ymin": y["lo"], "xmax": x["hi"], "ymax": y["hi"]}
    within = (c["xmin"] >= b["xmin"]) & (c["ymin"] >= b["ymin"]) & (c["xmax"] <= b["xmax"]) & (c["ymax"] <= b["ymax"])
    inside = ~F.exists("edges", lambda e: touches_box(e, c)) & inside_from(
        F.col("ref"), (x["lo"] + x["hi"]) / 2.0, (y["lo"] + y["hi"]) / 2.0, F.col("edges"))
    return (
        cut.filter(extent > 0).withColumn("lv", lv).withColumn("_x", spans(b["xmin"], b["xmax"])).withColumn("_y", spans(b["ymin"], b["ymax"]))
        .withColumn("full", F.when(within, inside).otherwise(F.lit(False)))
        .withColumn("cx", x["i"]).withColumn("cy", y["i"]).drop("_x", "_y"))


def cells_of(x: Column, y: Column, levels: list[int]) -> Column:
    """Cells of a point at each of the levels."""
    return F.array(*[F.struct(F.lit(v).alias("lv"), F.floor(x / F.lit(2.0**v)).alias("cx"), F.floor(y / F.lit(2.0**v)).alias("cy"))
                     for v in levels])


def levels_of(cells: DataFrame) -> list[int]:
    """Distinct levels, at most 61 numbers."""
    return sorted(r[0] for r in cells.select("lv").distinct().collect())
