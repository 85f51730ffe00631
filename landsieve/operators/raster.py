"""Terrain rasters as cell tables: (row, col, z), one row per grid cell.

A grid is described by x0, y0 (outer corner of cell 0,0), dx and dy; row grows
with y. Work that looks at neighbours runs on square blocks: a cell moves to its
block once, and only cells at a block's border move to the next one as well, so
that a block has the margin it needs and nothing is exchanged afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from landsieve.functions import geometry as G
from landsieve.operators import fragments as FR
from landsieve.operators.joins import salted_join
from landsieve.operators.spatial import points_in_polygons
from landsieve.session import materialize, ship_package

#: Cells to a side of a block.
BLOCK = 256

@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int

    def x(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + F.lit(0.5)) * F.lit(self.dx)

    def y(self, row: Column) -> Column:
        return F.lit(self.y0) + (row + F.lit(0.5)) * F.lit(self.dy)


def raster_mosaic(tiles: DataFrame) -> DataFrame:
    """Overlapping tiles (tile_order, row, col, z): the first tile with data wins."""
    return tiles.filter(F.col("z").isNotNull()).groupBy("row", "col").agg(F.min_by("z", "tile_order").alias("z"))


def raster_window(cells: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Crop to a row/col box; no overlap is an error."""
    out = cells.filter(F.col("row").between(row0, row1) & F.col("col").between(col0, col1))
    if out.isEmpty():
        raise ValueError("the window does not overlap the raster")
    return out


def in_blocks(cells: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Cells with the block (brow, bcol) they lie in, and once more for each block whose margin they are in.

    A block's margin is ``before`` cells ahead of its first row and column and ``after`` cells past its last, so a
    raster grows by about (before + after) * 2 / size.
    """
    def places(c: str) -> Column:
        at, inside = F.floor(F.col(c) / size), F.pmod(F.col(c), F.lit(size))
        return F.filter(F.array(at, F.when(inside < after, at - 1), F.when(inside >= size - before, at + 1)), lambda b: b.isNotNull())

    rows, cols = places("row"), places("col")
    both = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("brow"), c.alias("bcol")))))
    return cells.withColumn("_b", F.explode(both)).select("*", "_b.brow", "_b.bcol").drop("_b")


def _dense(block: pa.Table, size: int, before: int, after: int) -> tuple[np.ndarray, int, int]:
    """A block's values with its margin, missing ones NaN, and the row and column of its first cell of its own."""
    row0, col0 = block["brow"][0].as_py() * size, block["bcol"][0].as_py() * size
    z = np.full((size + before + after,) * 2, np.nan)
    z[block["row"].to_numpy() - row0 + before, block["col"].to_numpy() - col0 + before] = block["z"].to_numpy()
    return z, row0, col0


def _as_cells(found: DataFrame, like: DataFrame) -> DataFrame:
    """Rows and columns in the types they came in."""
    return found.withColumn("row", F.col("row").cast(like.schema["row"].dataType)).withColumn(
        "col", F.col("col").cast(like.schema["col"].dataType))


def _numbers(values: np.ndarray) -> pa.Array:
    """NaN as null."""
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def raster_resample(cells: DataFrame, source: Grid, target: Grid, to_source: Callable | None = None) -> DataFrame:
    """Bilinear resampling; missing neighbours (null or NaN) are left out and weights rescaled.

    ``to_source(x, y)`` turns target coordinates into source coordinates. Each target cell goes to the source block that
    holds the first of its four neighbours; that block's margin holds the others.
    """
    spark = cells.sparkSession
    t = (
        spark.range(target.rows * target.cols)
        .select(F.floor(F.col("id") / target.cols).alias("row"), F.pmod("id", F.lit(target.cols)).alias("col")))
    tx, ty = target.x(F.col("col")), target.y(F.col("row"))
    sx, sy = to_source(tx, ty) if to_source else (tx, ty)
    t = t.withColumn("fc", (sx - F.lit(source.x0)) / F.lit(source.dx) - 0.5).withColumn(
        "fr", (sy - F.lit(source.y0)) / F.lit(source.dy) - 0.5)
    inside = (
        F.col("fc").between(-0.5, source.cols - 0.5) & F.col("fr").between(-0.5, source.rows - 0.5))
    # a finer target gets smaller source blocks, so that a block's work stays bounded
    finer = max(1.0, target.rows * target.cols / max(1, source.rows * source.cols))
    size = max(8, int(BLOCK / finer ** 0.5))
    probes = t.filter(inside).withColumn("brow", F.floor(F.floor("fr") / size)).withColumn("bcol", F.floor(F.floor("fc") / size))
    known = cells.filter(F.col("z").isNotNull()).select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("z").cast("double"))
    schema = pa.schema([("row", pa.int64()), ("col", pa.int64()), ("z", pa.float64())])

    def bilinear(want: pa.Table, have: pa.Table) -> pa.Table:
        if not want.num_rows or not have.num_rows:
            return schema.empty_table()
        z, row0, col0 = _dense(have, size, 0, 1)
        fr, fc = want["fr"].to_numpy(), want["fc"].to_numpy()
        r0, c0 = np.floor(fr), np.floor(fc)
        wr, wc = fr - r0, fc - c0
        r, c = r0.astype(np.int64) - row0, c0.astype(np.int64) - col0
        total, weight = np.zeros(len(fr)), np.zeros(len(fr))
        for i in (0, 1):
            for j in (0, 1):
                w = (wr if i else 1.0 - wr) * (wc if j else 1.0 - wc)
                v = z[r + i, c + j]
                use = (w > 0) & ~np.isnan(v)
                total += np.where(use, w * np.where(use, v, 0.0), 0.0)
                weight += np.where(use, w, 0.0)
        hit = weight > 0
        return pa.table([want["row"].filter(pa.array(hit)), want["col"].filter(pa.array(hit)), pa.array(total[hit] / weight[hit])], schema=schema)

    ship_package(spark)
    return probes.select("row", "col", "fr", "fc", "brow", "bcol").groupBy("brow", "bcol").cogroup(
        in_blocks(known, size, 0, 1).groupBy("brow", "bcol")).applyInArrow(bilinear, "row long, col long, z double")


def slope_gradient(cells: DataFrame, rows: int, cols: int, dx: float, dy: float, size: int = BLOCK) -> DataFrame:
    """dz/dx and dz/dy: central differences inside, one-sided at the grid edge.

    A missing neighbour (null or NaN) inside the grid gives NULL.
    """
    schema = pa.schema([("row", pa.int64()), ("col", pa.int64()), ("dzdx", pa.float64()), ("dzdy", pa.float64())])

    def difference(low: np.ndarray, own: np.ndarray, high: np.ndarray, at: np.ndarray, n: int, step: float) -> np.ndarray:
        return np.where(at == 0, (high - own) / step, np.where(at == n - 1, (own - low) / step, (high - low) / (2.0 * step)))

    def gradient(block: pa.Table) -> pa.Table:
        z, row0, col0 = _dense(block, size, 1, 1)
        own = z[1:-1, 1:-1]
        r, c = np.nonzero(~np.isnan(own))
        row, col = r + row0, c + col0
        x = difference(z[r + 1, c], own[r, c], z[r + 1, c + 2], col, cols, dx)
        y = difference(z[r, c + 1], own[r, c], z[r + 2, c + 1], row, rows, dy)
        return pa.table([pa.array(row), pa.array(col), _numbers(x), _numbers(y)], schema=schema)

    ship_package(cells.sparkSession)
    known = cells.filter(F.col("z").isNotNull()).select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("z").cast("double"))
    found = in_blocks(known, size, 1, 1).groupBy("brow", "bcol").applyInArrow(gradient, "row long, col long, dzdx double, dzdy double")
    return _as_cells(found, cells)


def raster_slope(gradient: DataFrame) -> DataFrame:
    """Slope in percent; NULL where a gradient is missing."""
    gx, gy = F.col("dzdx"), F.col("dzdy")
    return gradient.select("row", "col", (F.sqrt(gx * gx + gy * gy) * 100.0).alias("value"))


def raster_mask(cells: DataFrame, grid: Grid, boundary: DataFrame, cell: float) -> DataFrame:
    """NULL where the cell centre is outside the boundary or the value is not finite."""
    pts = cells.select("row", "col", grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y")).withColumn(
        "_id", F.xxhash64("row", "col"))
    inside = points_in_polygons(pts, boundary.select("bbox", "edges"), cell, "x", "y", "_id", strict=False).select(
        "row", "col").distinct().withColumn("_in", F.lit(True))
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return cells.join(inside, ["row", "col"], "left").select(
        "row", "col", F.when(F.coalesce("_in", F.lit(False)) & finite, v).alias("value"))


def raster_stats(cells: DataFrame, grid: Grid) -> DataFrame:
    return cells.agg(
        F.min("value").alias("min_slope_pct"), F.max("value").alias("max_slope_pct"), F.avg("value").alias("mean_slope_pct"),
        F.count("value").alias("valid_cells")).select(
        "*", F.lit(grid.cols).alias("width"), F.lit(grid.rows).alias("height"),
        F.lit(grid.x0).alias("bbox_xmin"), F.lit(grid.y0).alias("bbox_ymin"),
        F.lit(grid.x0 + grid.cols * grid.dx).alias("bbox_xmax"), F.lit(grid.y0 + grid.rows * grid.dy).alias("bbox_ymax"))


def _reach(lo: Column, hi: Column, origin: float, step: float) -> tuple[Column, Column]:
    """First and last closed cell that a stretch meets, as their borders origin + k * step have it to the last bit."""
    border = lambda k: F.lit(origin) + k * F.lit(step)
    near = lambda v: F.floor((v - F.lit(origin)) / F.lit(step))
    first = G.let(near(lo), lambda k: F.when(border(k) >= lo, k - 1).when(border(k + 1) < lo, k + 1).otherwise(k))
    last = G.let(near(hi), lambda k: F.when(border(k + 1) <= hi, k + 1).when(border(k) > hi, k - 1).otherwise(k))
    return first, last


def _columns(lo: Column, hi: Column, grid: Grid) -> Column:
    """First and last column whose closed cells a stretch of x meets."""
    c0, c1 = _reach(lo, hi, grid.x0, grid.dx)
    return F.struct(F.greatest(c0, F.lit(0)).cast("int").alias("c0"), F.least(c1, F.lit(grid.cols - 1)).cast("int").alias("c1"))


def _strip(grid: Grid, row: Column) -> tuple[Column, Column]:
    return F.lit(grid.y0) + row * F.lit(grid.dy), F.lit(grid.y0) + (row + 1) * F.lit(grid.dy)


def _x_range(e: Column, low: Column, high: Column, grid: Grid) -> Column:
    """Columns that the part of an edge inside a strip meets; its ends keep their exact x."""
    def x_at(y):
        slope = (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return F.when(y == e["y1"], e["x1"]).when(y == e["y2"], e["x2"]).otherwise(e["x1"] + (y - e["y1"]) * slope)

    flat = e["y1"] == e["y2"]
    a = F.when(flat, e["x1"]).otherwise(x_at(F.greatest(F.least(e["y1"], e["y2"]), low)))
    b = F.when(flat, e["x2"]).otherwise(x_at(F.least(F.greatest(e["y1"], e["y2"]), high)))
    return _columns(F.least(a, b), F.greatest(a, b), grid)


def _crossing(e: Column, high: Column) -> Column:
    """Where an edge crosses the upper line of a strip, NULL if it doesn't."""
    return F.when((e["y1"] > high) != (e["y2"] > high), e["x1"] + (high - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))


def _rows_of(lo: Column, hi: Column, grid: Grid) -> Column:
    """Rows whose closed strips a stretch of y meets; an empty list past the grid."""
    first, last = _reach(lo, hi, grid.y0, grid.dy)
    r0, r1 = F.greatest(first, F.lit(0).cast("long")), F.least(last, F.lit(grid.rows - 1).cast("long"))
    return F.when(r0 <= r1, F.sequence(r0, r1)).otherwise(F.array().cast("array<bigint>"))


#: Pairs of an edge and a raster row that are worked on at once.
AT_ONCE = 1 << 20


def _np_reach(lo: np.ndarray, hi: np.ndarray, origin: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """``_reach`` of arrays."""
    border = lambda k: origin + k * step
    a, b = np.floor((lo - origin) / step), np.floor((hi - origin) / step)
    first = np.where(border(a) >= lo, a - 1, np.where(border(a + 1) < lo, a + 1, a))
    return first, np.where(border(b + 1) <= hi, b + 1, np.where(border(b) > hi, b - 1, b))


def _runs_of(of: np.ndarray, e: np.ndarray, first: np.ndarray, n: np.ndarray, grid: Grid) -> tuple[np.ndarray, ...]:
    """(polygon, row, c0, c1) of the runs of some polygons, from their edges ``e``, whose ``n`` strips start at ``first``."""
    at = np.repeat(np.arange(len(n)), n)
    row = first[at] + (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))
    of, (x1, y1, x2, y2) = of[at], e[at].T
    low, high = grid.y0 + row * grid.dy, grid.y0 + (row + 1) * grid.dy
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (x2 - x1) / (y2 - y1)
        x_at = lambda y: np.where(y == y1, x1, np.where(y == y2, x2, x1 + (y - y1) * slope))
        a = np.where(y1 == y2, x1, x_at(np.maximum(np.minimum(y1, y2), low)))
        b = np.where(y1 == y2, x2, x_at(np.minimum(np.maximum(y1, y2), high)))
        crosses = (y1 > high) != (y2 > high)
        x = (x1 + (high - y1) * (x2 - x1) / (y2 - y1))[crosses]
    by = np.lexsort((x, row[crosses], of[crosses]))
    x, c_of, c_row = x[by], of[crosses][by], row[crosses][by]
    new = np.flatnonzero(np.diff(c_of, prepend=-1).astype(bool) | np.diff(c_row, prepend=-1).astype(bool))
    place = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
    pair = np.flatnonzero((place[:-1] % 2 == 0) & (place[1:] == place[:-1] + 1)) if len(x) else new
    of, row = np.concatenate([of, c_of[pair]]), np.concatenate([row, c_row[pair]])
    c0, c1 = _np_reach(np.concatenate([np.minimum(a, b), x[pair]]), np.concatenate([np.maximum(a, b), x[pair + 1]]), grid.x0, grid.dx)
    c0, c1 = np.maximum(c0, 0).astype(np.int64), np.minimum(c1, grid.cols - 1).astype(np.int64)
    some = np.flatnonzero(c0 <= c1)
    some = some[np.lexsort((c0[some], row[some], of[some]))]
    of, row, c0, c1 = of[some], row[some], c0[some], c1[some]
    if not len(some):
        return of, row, c0, c1
    fresh = np.diff(of, prepend=-1).astype(bool) | np.diff(row, prepend=-1).astype(bool)
    # the farthest column so far in the same row of the same polygon
    base = np.cumsum(fresh) * (grid.cols + 1)
    far = np.maximum.accumulate(base + c1) - base
    starts = np.flatnonzero(fresh | (c0 > np.append(0, far[:-1]) + 1))
    ends = np.append(starts[1:], len(far)) - 1
    return of[starts], row[starts], c0[starts], far[ends]


def covered_runs(parcels: DataFrame, grid: Grid, keep: list[str], large: int = 10_000) -> DataFrame:
    """Runs of cells (row, c0, c1) that each parcel touches, with the columns ``keep``.

    Inside the strip of one raster row a polygon shows as the stretches of its edges there and the stretches between
    its crossings of the strip's upper line; overlapping ones are merged. Rows grow with a parcel's height, not its
    area. Polygons are gone through in Arrow batches; the edges of large ones are dealt to the strips they meet instead.
    """
    keep = list(dict.fromkeys(keep))
    low, high = _strip(grid, F.col("row"))
    big = F.size("edges") > large
    own = parcels.select(*keep)
    schema = own.select("*", F.lit(0).cast("long").alias("row"), F.lit(0).alias("c0"), F.lit(0).alias("c1")).schema
    out = to_arrow_schema(schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at, e = FR._structs(batch["edges"], FR.EDGE)
            if not len(e):
                continue
            first, last = _np_reach(np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3]), grid.y0, grid.dy)
            first, last = np.maximum(first, 0), np.minimum(last, grid.rows - 1)
            # edges without numbers meet no strip
            n = np.where(last >= first, last - first + 1, 0).astype(np.int64)
            first = np.where(n > 0, first, 0).astype(np.int64)
            before = np.append(0, np.cumsum(n))[at]
            of, lot = np.repeat(np.arange(len(at) - 1), np.diff(at)), before[:-1] // AT_ONCE
            for start, stop in zip(cuts := np.flatnonzero(np.diff(lot, prepend=-1)), np.append(cuts[1:], len(lot)), strict=True):
                s = slice(at[start], at[stop])
                who, row, c0, c1 = _runs_of(of[s], e[s], first[s], n[s], grid)
                if len(who):
                    made = {"row": pa.array(row), "c0": pa.array(c0.astype(np.int32)), "c1": pa.array(c1.astype(np.int32))}
                    ids = pa.array(who)
                    yield pa.RecordBatch.from_arrays([made[c] if c in made else batch[c].take(ids) for c in out.names], schema=out)

    ship_package(parcels.sparkSession)
    small = parcels.filter(~big).select(*keep, "edges").mapInArrow(run, schema)
    e = F.col("e")
    dealt = (
        parcels.filter(big).select(F.struct(*keep).alias("own"), F.explode("edges").alias("e"))
        .withColumn("row", F.explode(_rows_of(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]), grid)))
        .groupBy("own", "row").agg(F.collect_list(_x_range(e, low, high, grid)).alias("ranges"), F.collect_list(_crossing(e, high)).alias("xs"))
        .select(*[F.col(f"own.{c}").alias(c) for c in keep], "row", "ranges", F.array_sort("xs").alias("xs")))
    xs, pairs = F.col("xs"), (F.size("xs") / 2).cast("int")
    inner = F.when(pairs > 0, F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: _columns(xs[i * 2], xs[i * 2 + 1], grid)))
    kind = "array<struct<c0:int,c1:int>>"
    spans = F.array_sort(F.filter(F.concat("ranges", F.coalesce(inner, F.array().cast(kind))), lambda r: r["c0"] <= r["c1"]))

    def merge(acc, r):
        last = F.element_at(acc, -1)
        longer = F.struct(last["c0"].alias("c0"), F.greatest(last["c1"], r["c1"]).alias("c1"))
        return F.when(F.size(acc) == 0, F.array(r)).when(
            r["c0"] <= last["c1"] + 1, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(r)))

    merged = dealt.select(*keep, "row", F.explode(F.aggregate(spans, F.array().cast(kind), merge)).alias("r")).select(*keep, "row", "r.c0", "r.c1")
    return small.unionByName(merged)


#: Cells of a raster row that are added up together; runs are cut there.
SEGMENT = 256


def in_segments(runs: DataFrame) -> DataFrame:
    """Runs cut at the borders of segments, with the number ``seg`` of theirs."""
    seg = F.col("seg")
    return runs.withColumn("seg", F.explode(F.sequence(F.floor(F.col("c0") / SEGMENT), F.floor(F.col("c1") / SEGMENT)))).withColumn(
        "c0", F.greatest("c0", seg * SEGMENT).cast("int")).withColumn("c1", F.least("c1", (seg + 1) * SEGMENT - 1).cast("int"))


def assign_runs(parcels: DataFrame, grid: Grid, order: list[str], mode: str = "last") -> DataFrame:
    """Runs of cells (id, row, seg, c0, c1) that belong to each parcel.

    ``all``: every parcel has what it touches. ``last``: a cell belongs to the last parcel in ``order``; the runs of one
    segment are painted over one another in that order. Equal runs are first reduced to the last, so a segment holds
    no more runs than it has pairs of cells, however many parcels lie on one another.
    """
    runs = in_segments(covered_runs(parcels, grid, ["id", *order]))
    if mode == "all":
        return runs.select("id", "row", "seg", "c0", "c1")
    top = runs.groupBy("row", "seg", "c0", "c1").agg(F.max(F.struct(F.struct(*order).alias("k"), F.col("id").alias("id"))).alias("w"))
    id_type = parcels.schema["id"].dataType.simpleString()

    def paint(group: pa.Table) -> pa.Table:
        start = group["seg"][0].as_py() * SEGMENT
        c0, c1 = group["c0"].to_numpy() - start, group["c1"].to_numpy() - start
        owner = np.full(SEGMENT, -1)
        for i in np.argsort(group["place"].to_numpy(), kind="stable"):
            owner[c0[i]:c1[i] + 1] = i
        edge = np.flatnonzero(np.diff(owner, prepend=-2))
        last = np.append(edge[1:], SEGMENT) - 1
        mine = owner[edge] >= 0
        who = pa.array(owner[edge][mine])
        return pa.table([group["id"].take(who), group["row"].take(who), group["seg"].take(who),
                         pa.array((edge[mine] + start).astype(np.int32)), pa.array((last[mine] + start).astype(np.int32))],
                        names=["id", "row", "seg", "c0", "c1"])

    ship_package(parcels.sparkSession)
    place = F.row_number().over(Window.partitionBy("row", "seg").orderBy("w")).alias("place")
    return top.select(F.col("w.id").alias("id"), "row", "seg", "c0", "c1", place).groupBy("row", "seg").applyInArrow(
        paint, f"id {id_type}, row long, seg long, c0 int, c1 int")


def touched_cells(parcels: DataFrame, grid: Grid) -> DataFrame:
    """(id, row, col) of every grid cell a parcel's metric polygon touches."""
    return covered_runs(parcels, grid, ["id"]).select("id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def raster_assign(parcels: DataFrame, grid: Grid, order: list[str], mode: str = "last") -> DataFrame:
    """Cells per parcel. ``last``: a cell belongs to the last parcel in ``order``;
    ``all``: to every parcel that touches it."""
    return assign_runs(parcels, grid, order, mode).select("id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def row_sums(cells: DataFrame) -> DataFrame:
    """Per row and segment the running sums and counts of its valid cells: row, seg, sums, counts.

    Entry k covers the segment's first k cells.
    """
    good = cells.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    at = F.pmod(F.col("col"), F.lit(SEGMENT)).cast("int")
    held = good.groupBy(F.col("row").cast("long").alias("row"), F.floor(F.col("col") / SEGMENT).alias("seg")).agg(
        F.collect_list(at).alias("at"), F.collect_list(F.col("value").cast("double")).alias("vs"))
    width = SEGMENT

    def running(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n = batch.num_rows
            line, at = np.repeat(np.arange(n), np.diff(batch["at"].offsets.to_numpy())), batch["at"].flatten().to_numpy()
            sums, counts = np.zeros((n, width + 1)), np.zeros((n, width + 1), np.int32)
            sums[line, at + 1], counts[line, at + 1] = batch["vs"].flatten().to_numpy(), 1
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * (width + 1))
            listed = [pa.ListArray.from_arrays(ends, pa.array(np.cumsum(v, axis=1, dtype=v.dtype).ravel())) for v in (sums, counts)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["seg"], *listed], names=["row", "seg", "sums", "counts"])

    ship_package(cells.sparkSession)
    return held.mapInArrow(running, "row long, seg long, sums array<double>, counts array<int>")


def zonal_mean(assigned: DataFrame, cells: DataFrame, name: str = "mean_slope_pct") -> DataFrame:
    """Mean value of the valid cells assigned to each parcel, from its cells or, cheaper, its runs.

    A run is settled by two entries of its segment's running sums, whatever its length.
    """
    if "c0" in assigned.columns:
        sums, a, b = row_sums(cells), F.col("c0") - F.col("seg") * SEGMENT, F.col("c1") - F.col("seg") * SEGMENT + 1
        get = lambda c, i: F.col(c)[i.cast("int")]
        # many parcels meet one row of a small raster: its runs are dealt out
        parts = salted_join(materialize(assigned, "runs"), materialize(sums, "row-sums"), ["row", "seg"], "id").select(
            "id", (get("sums", b) - get("sums", a)).alias("s"), (get("counts", b) - get("counts", a)).alias("n"))
        return parts.groupBy("id").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0").select(
            "id", (F.col("s") / F.col("n")).alias(name))
    good = cells.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return assigned.join(good, ["row", "col"]).groupBy("id").agg(F.avg("value").alias(name))


def two_resolution(parcels: DataFrame, coarse: DataFrame, coarse_grid: Grid, fine: DataFrame | None,
                   fine_grid: Grid | None, order: list[str], mode: str = "last") -> DataFrame:
    """Screening mean for every parcel, and a second, finer mean where there is one."""
    out = parcels.select("id").join(zonal_mean(assign_runs(parcels, coarse_grid, order, mode), coarse), "id", "left")
    if fine is None:
        return out.withColumn("mean_slope_pct_final", F.lit(None).cast("double"))
    final = zonal_mean(assign_runs(parcels, fine_grid, order, mode), fine, "mean_slope_pct_final")
    return out.join(final, "id", "left")


def grid_points(boxes: DataFrame, spacing: float) -> DataFrame:
    """Regular points over each box (box_id, bbox), edges included."""
    b = F.col("bbox")
    n = lambda lo, hi: F.floor((hi - lo + F.lit(1e-9)) / F.lit(spacing)).cast("int")
    return (
        boxes.withColumn("j", F.explode(F.sequence(F.lit(0), n(b["ymin"], b["ymax"]))))
        .withColumn("i", F.explode(F.sequence(F.lit(0), n(b["xmin"], b["xmax"]))))
        .withColumn("lon", b["xmin"] + F.col("i") * F.lit(spacing)).withColumn("lat", b["ymin"] + F.col("j") * F.lit(spacing)))
