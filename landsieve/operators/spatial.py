"""Spatial joins as equi-joins on grid cells.

Features carry ``bbox`` (struct), and polygons also ``edges`` and ``anchors``
(see functions.geometry). All results are exact: cells only choose candidates,
the exact test decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from landsieve.functions import geometry as G
from landsieve.operators import fragments as FR
from landsieve.operators.circle_totals import circle_totals
from landsieve.operators.joins import BROADCAST_POINTS, BROADCAST_ROWS, lookup_join, salted_join, small_side
from landsieve.operators.near_lists import near_items
from landsieve.session import materialize, ship_package

LEVEL_STEP = 8
MAX_LEVELS = 10


def polygon_columns(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Add bbox, edges and anchors of a polygon column."""
    return (
        df.withColumn("bbox", G.bbox(F.col(parts)))
        .withColumn("edges", G.edges(F.col(parts)))
        .withColumn("anchors", G.anchors(F.col(parts)))
    )


def _level(bbox: Column, cell: float) -> Column:
    """Grid level at which the box spans at most two cells per axis."""
    extent = F.greatest(bbox["xmax"] - bbox["xmin"], bbox["ymax"] - bbox["ymin"])
    raw = F.ceil(F.log(extent / F.lit(cell)) / F.lit(math.log(LEVEL_STEP)))
    return F.when(extent <= F.lit(cell), F.lit(0)).otherwise(
        F.greatest(F.least(raw, F.lit(MAX_LEVELS)), F.lit(0))
    ).cast("int")


def _levels_present(df: DataFrame, cell: float) -> list[int]:
    """Distinct grid levels in use, at most MAX_LEVELS + 1 numbers."""
    return sorted(r[0] for r in df.select(_level(F.col("bbox"), cell).alias("v")).distinct().collect())


def _emit_cells(df: DataFrame, cell: float, both: int, mine: int, theirs: int, other: list[int]) -> DataFrame:
    """One row per (level, tag, cell) a feature takes part in.

    A pair is compared at the coarser of its two levels. ``both`` pairs equal
    levels, ``mine`` pairs this feature's own level with finer partners, and
    ``theirs`` registers this feature at the coarser levels of the other side.
    """
    sizes = F.array(*[F.lit(cell * LEVEL_STEP**v) for v in range(MAX_LEVELS + 1)])
    b, lv = F.col("bbox"), F.col("_lv")

    def entry(v, tag):
        return F.struct(v.cast("int").alias("v"), F.lit(tag).alias("tag"))

    slots = [F.array(entry(lv, both))]
    if min(other, default=0) < MAX_LEVELS:
        slots.append(F.when(lv > min(other, default=0), F.array(entry(lv, mine)))
                     .otherwise(F.array().cast("array<struct<v:int,tag:int>>")))
    ups = [v for v in other if v > 0]
    if ups:
        slots.append(F.filter(F.array(*[entry(F.lit(v), theirs) for v in ups]), lambda e: e["v"] > lv))

    def cells(e):
        size = F.element_at(sizes, e["v"] + 1)
        xs = F.sequence(F.floor(b["xmin"] / size), F.floor(b["xmax"] / size))
        ys = F.sequence(F.floor(b["ymin"] / size), F.floor(b["ymax"] / size))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(
            e["v"].alias("v"), e["tag"].alias("tag"), x.alias("cx"), y.alias("cy")
        ))))

    return (
        df.withColumn("_lv", _level(b, cell))
        .withColumn("_c", F.explode(F.flatten(F.transform(F.concat(*slots), cells))))
        .select("*", "_c.v", "_c.tag", "_c.cx", "_c.cy").drop("_c", "_lv")
    )


def overlap_join(left: DataFrame, right: DataFrame, cell: float, left_id: str = "id",
                 left_points: bool = False) -> DataFrame:
    """All pairs whose bounding boxes meet, each exactly once.

    Right columns come back prefixed with ``r_``. A pair is kept only in the
    cell holding the lower-left corner of the two boxes' common part, so no
    distinct step is needed. Features of very different size meet at the
    coarser one's level, so nothing explodes into many cells. The right side is
    broadcast only when proven small; otherwise crowded cells are salted.
    """
    right = right.select(*[F.col(c).alias("bbox" if c == "bbox" else f"r_{c}") for c in right.columns])
    keys = ["v", "tag", "cx", "cy"]
    # One look at no more than BROADCAST_ROWS + 1 rows settles size and levels.
    weight = F.sum(F.size("r_edges")) if "r_edges" in right.columns else F.lit(0)
    seen, points, levels = right.limit(BROADCAST_ROWS + 1).agg(
        F.count("*"), weight, F.collect_set(_level(F.col("bbox"), cell))).first()
    if seen <= BROADCAST_ROWS and (points or 0) <= BROADCAST_POINTS:
        # Few right rows: register them at every coarser level instead of asking the left side.
        l_levels = [0] if left_points else list(range(MAX_LEVELS + 1))
        lhs = _emit_cells(left, cell, 0, 1, 2, sorted(levels))
        rhs = _emit_cells(right, cell, 0, 2, 1, l_levels).withColumnRenamed("bbox", "r_bbox")
        pairs = lhs.join(F.broadcast(rhs), keys)
    else:
        lhs = _emit_cells(left, cell, 0, 1, 2, _levels_present(right, cell))
        rhs = _emit_cells(right, cell, 0, 2, 1, [0] if left_points else _levels_present(left, cell))
        pairs = salted_join(lhs, rhs.withColumnRenamed("bbox", "r_bbox"), keys, left_id)
    size = F.lit(cell) * F.pow(F.lit(float(LEVEL_STEP)), F.col("v"))
    a, b = F.col("bbox"), F.col("r_bbox")
    return pairs.filter(
        G.bbox_overlaps(a, b)
        & (F.floor(F.greatest(a["xmin"], b["xmin"]) / size) == F.col("cx"))
        & (F.floor(F.greatest(a["ymin"], b["ymin"]) / size) == F.col("cy"))
    ).drop(*keys)


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, x: str, y: str,
                       point_id: str = "id", strict: bool = True) -> DataFrame:
    """Pairs of points and the polygons that contain them.

    Where polygons are large enough to be cut into pieces, a point on the border of two
    pieces comes once for each.
    """
    pts = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn(
        "bbox", G.point_bbox(F.col(x), F.col(y)))
    if "anchors" not in polygons.columns:
        polygons = polygons.withColumn("anchors", F.array().cast(f"array<{G.POINT_T}>"))
    cut, _ = FR.pieces(polygons)
    return overlap_join(pts, cut, cell, point_id, left_points=True).filter(
        FR.piece_contains(F.col(x), F.col(y), "r_", strict)).drop("r_ref", "r_anchors")


def intersecting(left: DataFrame, right: DataFrame, cell: float, left_id: str = "id", right_id: str | None = None,
                 cut_left: bool = False) -> DataFrame:
    """Pairs of polygons that share at least one point.

    Large polygons on the right are cut into pieces first, so a test reads one piece's edges and pieces travel in place
    of whole edge arrays; ``cut_left`` does the same on the left, for one more look at its rows. A pair then shows in
    several pieces; with ``right_id`` it comes once.
    """
    b, b_cut = FR.pieces(right)
    a, a_cut = FR.pieces(left) if cut_left else (FR.one_piece(left), False)
    if not a_cut and not b_cut:
        return overlap_join(left, right, cell, left_id).filter(
            G.polygons_intersect(F.col("edges"), F.col("anchors"), F.col("r_edges"), F.col("r_anchors")))
    pairs = overlap_join(a, b, cell, left_id).filter(FR.pieces_intersect()).drop("ref", "r_ref")
    return pairs.dropDuplicates([left_id, f"r_{right_id}"]) if right_id else pairs


def meeting(left: DataFrame, right: DataFrame, cell: float, left_id: str = "id") -> DataFrame:
    """Ids of the left polygons that share at least one point with any right one, each once.

    A left polygon with a vertex in a cell wholly inside a right one is settled by that alone, however many there are
    on top of one another; only what lies in the gaps is joined polygon by polygon.
    """
    cut, _ = FR.pieces(right)
    cut = materialize(cut, "pieces", deal=True)
    full = materialize(FR.cover_cells(cut).filter("full").select("lv", "cx", "cy").distinct(), "covered-cells")
    left = left.select(left_id, "bbox", "edges", "anchors")
    levels = FR.levels_of(full)
    if not levels:
        return intersecting(left, right, cell, left_id).select(left_id).distinct()
    v = F.get(F.col("edges"), F.lit(0))
    probe = left.select(left_id, F.explode(FR.cells_of(v["x1"], v["y1"], levels)).alias("_c")).select(left_id, "_c.*")
    keys = ["lv", "cx", "cy"]
    known = materialize(probe.join(F.broadcast(full) if small_side(full) else full, keys, "left_semi").select(left_id).distinct(), "covered")
    rest = materialize(left.join(known, left_id, "left_anti"), "uncovered", deal=True)
    return known.unionByName(intersecting(rest, right, cell, left_id).select(left_id).distinct())


def smallest_container(points: DataFrame, polygons: DataFrame, cell: float, x: str, y: str,
                       point_id: str, area: str, poly_id: str, keep: list[str]) -> DataFrame:
    """Per point the smallest polygon strictly containing it; ties by polygon id.

    The smallest polygon that a grid cell lies wholly inside contains all points of the cell, so they are tested only
    against smaller ones whose boundary passes it. How many these are doesn't grow with the number of polygons on top
    of one another. ``cell`` is not needed for that and stays for callers.
    """
    points = points.select(point_id, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    best = F.struct(F.col(area).alias("area"), F.col(poly_id).alias("pid"), *keep)
    cut, _ = FR.pieces(polygons.select(best.alias("best"), "bbox", "edges", F.array().cast(f"array<{G.POINT_T}>").alias("anchors")))
    cut = materialize(cut, "pieces", deal=True)
    cells, keys = FR.cover_cells(cut), ["lv", "cx", "cy"]
    seen = materialize(cells.select(*keys, "full", "best"), "cells-seen")
    full = materialize(seen.filter("full").groupBy(*keys).agg(F.min("best").alias("bound")), "full-cells")
    rims = cells.filter(~F.col("full"))
    asked_rims = materialize(seen.filter(~F.col("full")).select(*keys).distinct(), "rim-cells")
    levels = sorted({*FR.levels_of(full), *FR.levels_of(asked_rims)})
    at = FR.cells_of(F.col(x), F.col(y), levels[:1] or [0])[0]
    placed = points.withColumn("_c", at).select(point_id, x, y, F.col("_c.lv").alias("lv"), F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy"))
    own = materialize(placed.select(*keys).distinct(), "point-cells")

    def up(df: DataFrame) -> DataFrame:
        """Each cell with the cells of its own and coarser levels it lies in (ulv, ux, uy)."""
        above = F.filter(F.array(*[F.lit(v) for v in levels or [0]]), lambda v: v >= F.col("lv"))
        return df.withColumn("ulv", F.explode(above)).withColumn("ux", F.expr("shiftright(cx, ulv - lv)")).withColumn(
            "uy", F.expr("shiftright(cy, ulv - lv)"))

    over = full.select(F.col("lv").alias("ulv"), F.col("cx").alias("ux"), F.col("cy").alias("uy"), "bound")
    bounds = materialize(up(asked_rims.unionByName(own).distinct()).join(over, ["ulv", "ux", "uy"]).groupBy(*keys).agg(
        F.min("bound").alias("bound")), "cell-bounds")
    smaller = F.col("bound").isNull() | (F.col("best") < F.col("bound"))
    open_rims = materialize(rims.select(*keys, "best", "bbox", "edges", "ref").join(bounds, keys, "left").filter(smaller).drop("bound"), "open-rims")
    size = F.pow(F.lit(2.0), F.col("lv"))
    b, x0, y0, rim = F.col("bbox"), F.col("cx") * size, F.col("cy") * size, size * F.lit(1e-6)
    meets = ((b["xmin"] <= x0 + size + rim) & (b["xmax"] >= x0 - rim) & (b["ymin"] <= y0 + size + rim) & (b["ymax"] >= y0 - rim))
    tests = materialize(
        up(own).join(open_rims.select(F.col("lv").alias("ulv"), F.col("cx").alias("ux"), F.col("cy").alias("uy"), "best", "bbox", "edges", "ref"),
                     ["ulv", "ux", "uy"]).drop("ulv", "ux", "uy").filter(meets).join(bounds, keys, "left").filter(smaller)
        .select(*keys, "best", F.col("bbox").alias("r_bbox"), F.col("edges").alias("r_edges"), F.col("ref").alias("r_ref")), "cell-tests")
    near = placed.join(F.broadcast(tests), keys) if small_side(tests, F.size("r_edges")) else salted_join(placed, tests, keys, point_id)
    r = F.col("r_bbox")
    hits = near.filter(F.col(x).between(r["xmin"], r["xmax"]) & F.col(y).between(r["ymin"], r["ymax"])).filter(
        FR.piece_contains(F.col(x), F.col(y), "r_", True)).select(point_id, "best")
    whole = lookup_join(placed, bounds, keys, "inner").select(point_id, F.col("bound").alias("best"))
    return whole.unionByName(hits).groupBy(point_id).agg(F.min("best").alias("b")).select(
        point_id, F.col("b.pid").alias("container_id"), *[F.col(f"b.{c}").alias(c) for c in keep])


# --- nearest neighbour ---------------------------------------------------------

FEW = 64
MANY = 4096
SMALL_ITEMS = 1024
SMALL_CELL_LEVEL = 5
START_LEVEL = 4
#: Steps of the grid by which the cells of items are finer than those of points, and the finest at which all points are counted.
FINER, COUNTED_LEVEL = 2, 9
PAIR_BUDGET = 1 << 14
#: Points of one cell that are weighed at once.
NEAR_POINTS = 1 << 16
DEEPEST = 14


def _cells_at(df: DataFrame, level_from: int, level_to: int, prefix: str) -> DataFrame:
    shift = level_from - level_to
    return df.select(
        F.shiftright(f"{prefix}x", shift).alias(f"{prefix}x"), F.shiftright(f"{prefix}y", shift).alias(f"{prefix}y"),
        *[c for c in df.columns if c not in (f"{prefix}x", f"{prefix}y")],
    )


def _candidate_cells(lk: DataFrame, rcells: DataFrame, deepest: int, x0: float, y0: float,
                     size: float) -> list[tuple[int, int, DataFrame, bool]]:
    """For each occupied left cell, the right cells that can hold the nearest item of a point in it.

    Walks down the grid one step at a time, the right cells being finer. A right cell is dropped when one point of an
    item elsewhere is nearer to all four corners of the left cell than any item of the right cell is; it is then nearer
    to all points of the left cell (see ``near_lists``). Such points are tried from five right cells. A left cell is
    finished once its candidates hold at most FEW items, or no more than MANY and either no more than it has points or few
    pairs with them, or at the deepest level. Returns (level, right level, pairs, few) with pairs
    (ax, ay, bx, by, m), m being the points in the left cell; ``few`` says that no left cell of the part has more than
    MANY items.
    """
    done: list[tuple[int, int, DataFrame, bool]] = []
    open_pairs: DataFrame | None = None
    level = min(START_LEVEL, deepest)
    parent, right_parent, counted = 0, 0, min(deepest, COUNTED_LEVEL)
    lcells = materialize(_cells_at(lk.select("ax", "ay"), deepest, counted, "a").groupBy("ax", "ay").agg(F.count("*").alias("m")), "nearest-left")
    while True:
        right_level = min(level + FINER, deepest)
        if level > counted:
            # only what lies in cells that are still open is counted any finer
            left = _cells_at(lk.select("ax", "ay"), deepest, deepest, "a").withColumn(
                "pax", F.shiftright("ax", deepest - parent)).withColumn("pay", F.shiftright("ay", deepest - parent))
            lcells = materialize(left.join(open_pairs.select("pax", "pay").distinct(), ["pax", "pay"], "left_semi").groupBy("ax", "ay").agg(
                F.count("*").alias("m")), "nearest-left")
            counted = deepest
        la = _cells_at(lcells, counted, level, "a").groupBy("ax", "ay").agg(F.sum("m").alias("m"))
        rb = _cells_at(rcells, deepest, right_level, "b").groupBy("bx", "by").agg(
            F.sum("n").alias("n"), F.max("reach").alias("reach"), F.min("spot").alias("spot"),
            *[f(c).alias(c) for f, c in ((F.min, "rx0"), (F.min, "ry0"), (F.max, "rx1"), (F.max, "ry1"))])
        shift, right_shift = level - parent, right_level - right_parent
        la = la.withColumn("pax", F.shiftright("ax", shift)).withColumn("pay", F.shiftright("ay", shift))
        rb = rb.withColumn("pbx", F.shiftright("bx", right_shift)).withColumn("pby", F.shiftright("by", right_shift))
        if open_pairs is None:
            # The one root cell on both sides: at most 4**START_LEVEL and 4**(START_LEVEL + FINER) rows.
            cand = la.join(rb, (F.col("pax") == F.col("pbx")) & (F.col("pay") == F.col("pby")))
        else:
            cand = open_pairs.join(la, ["pax", "pay"]).join(rb, ["pbx", "pby"])
        s = size / 2**level
        slack = s * 1e-6
        lo_x, lo_y = F.lit(x0) + F.col("ax") * F.lit(s) - F.lit(slack), F.lit(y0) + F.col("ay") * F.lit(s) - F.lit(slack)
        hi_x, hi_y, mid = lo_x + F.lit(s + 2 * slack), lo_y + F.lit(s + 2 * slack), F.lit(s / 2)
        corners = [(lo_x, lo_y), (lo_x, hi_y), (hi_x, lo_y), (hi_x, hi_y)]

        def length(dx, dy):
            return F.sqrt(dx * dx + dy * dy)

        def low(x, y):
            return length(F.greatest(F.col("rx0") - x, x - F.col("rx1"), F.lit(0.0)),
                          F.greatest(F.col("ry0") - y, y - F.col("ry1"), F.lit(0.0))) - F.col("reach") - F.lit(slack)

        def high(x, y):
            return length(F.col("spot.rx") - x, F.col("spot.ry") - y)

        tries = ["h4", "h0", "h1", "h2", "h3"]
        pairs = cand.select("ax", "ay", "bx", "by", "m", "n", F.array(*[low(x, y) for x, y in corners]).alias("low"),
                            high(lo_x + mid, lo_y + mid).alias("h4"), *[high(x, y).alias(f"h{k}") for k, (x, y) in enumerate(corners)])
        for k in tries:
            pairs = pairs.withColumn(f"by_{k}", F.expr(f"min(struct({k} as least, h0, h1, h2, h3)) over (partition by ax, ay)"))
        beaten = [F.col(f"by_{k}.h0") <= F.col("low")[0] for k in tries]
        for i in (1, 2, 3):
            beaten = [b & (F.col(f"by_{k}.h{i}") <= F.col("low")[i]) for k, b in zip(tries, beaten, strict=True)]
        out = beaten[0]
        for b in beaten[1:]:
            out = out | b
        total, m = F.col("total"), F.col("m")
        pairs = pairs.filter(~out).withColumn("total", F.expr("sum(n) over (partition by ax, ay)")).withColumn(
            "few", (total <= FEW) | ((total <= MANY) & ((total <= m) | (total * m <= PAIR_BUDGET)))).select("ax", "ay", "bx", "by", "m", "few")
        pairs = materialize(pairs, "nearest-cells")
        last = level >= deepest
        n_few, n_many = pairs.agg(F.count_if("few"), F.count_if(~F.col("few"))).first()
        if n_few:
            done.append((level, right_level, pairs.filter("few"), True))
        if not n_many:
            return done
        many = pairs.filter("not few")
        if last:
            done.append((level, right_level, many, False))
            return done
        open_pairs = many.select(F.col("ax").alias("pax"), F.col("ay").alias("pay"),
                                 F.col("bx").alias("pbx"), F.col("by").alias("pby"))
        parent, right_parent, level = level, right_level, level + 1


def _small_candidates(right: DataFrame, item_cols: list[str], n_right: int, x0: float, y0: float,
                      size: float) -> tuple[int, DataFrame]:
    """Candidate items per grid cell when there are at most SMALL_ITEMS of them.

    The whole item list is weighed against each cell of a grid of at most
    4**SMALL_CELL_LEVEL cells, so the result has at most SMALL_ITEMS times that
    many entries (about a million) however the items lie.
    """
    level = min(SMALL_CELL_LEVEL, max(2, math.ceil(math.log(n_right, 4))))
    s = size / 2**level
    spark = right.sparkSession
    items = right.agg(F.collect_list(F.struct(*item_cols, "reach")).alias("items")).scalar()
    cells = (
        spark.range(0, 4**level, 1, min(4**level, spark.sparkContext.defaultParallelism))
        .select(F.shiftright("id", level).alias("ax"), F.col("id").bitwiseAND(F.lit(2**level - 1)).alias("ay"))
        .withColumn("lo_x", F.lit(x0) + F.col("ax") * F.lit(s)).withColumn("lo_y", F.lit(y0) + F.col("ay") * F.lit(s))
        .withColumn("all", items)
    )
    lo_x, lo_y, hi_x, hi_y = F.col("lo_x"), F.col("lo_y"), F.col("lo_x") + F.lit(s), F.col("lo_y") + F.lit(s)

    def far(i):
        dx = F.greatest(F.abs(i["rx"] - lo_x), F.abs(i["rx"] - hi_x))
        dy = F.greatest(F.abs(i["ry"] - lo_y), F.abs(i["ry"] - hi_y))
        return dx * dx + dy * dy

    def near(i):
        dx = F.greatest(lo_x - i["rx"], i["rx"] - hi_x, F.lit(0.0))
        dy = F.greatest(lo_y - i["ry"], i["ry"] - hi_y, F.lit(0.0))
        return F.sqrt(dx * dx + dy * dy) - i["reach"]

    # The bound is taken once per cell and then used for every item.
    found = G.let(F.array_min(F.transform("all", far)), lambda h: F.filter(
        F.col("all"), lambda i: near(i) <= F.sqrt(h) + F.lit(size * 1e-9)))
    return level, cells.select("ax", "ay", found.alias("items"))


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, x: str, y: str, item_distance,
                 order: str, payload: list[str], reach: str | None = None, needs: list[str] = (),
                 segment: list[str] | None = None) -> DataFrame:
    """Per left point the right item with the least (distance, ``order``).

    ``right`` needs ``rx, ry`` (a point of the item) and, for items with size,
    a ``reach`` column: no point of the item is farther than that from it.
    ``item_distance(px, py, item)`` gives the exact distance, ``item`` being a
    struct of ``payload``, ``needs`` and rx, ry. With ``segment`` (columns x, y, dx, dy among ``needs``) it is the
    distance to that segment, of which the item is a part. Returns left_id, dist, order and payload; left points without
    coordinates are left out.

    Candidates come from a walk down a grid over cell summaries, so the cost
    does not depend on how unevenly either side is spread; only cells that are
    still crowded at the deepest level are joined item by item (salted).

    Both sides are written once as thin tables, since several steps read them
    and their coordinates may be costly to derive.
    """
    left = materialize(left.select(left_id, x, y), "nearest-points", deal=True).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    item_cols = list(dict.fromkeys([order, *payload, *needs, "rx", "ry"]))
    right = materialize(right.select(*item_cols, (F.col(reach) if reach else F.lit(0.0)).alias("reach")), "nearest-items").filter(
        F.col("rx").isNotNull() & F.col("ry").isNotNull())
    out_cols = [left_id, "dist", *dict.fromkeys([order, *payload])]

    lx0, ly0, lx1, ly1 = left.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    rx0, ry0, rx1, ry1, n_right = right.agg(F.min("rx"), F.min("ry"), F.max("rx"), F.max("ry"), F.count("*")).first()
    if not n_right or lx0 is None:
        empty = left.select(left_id).filter(F.lit(False)).withColumn("dist", F.lit(None).cast("double"))
        fields = {f.name: f.dataType for f in right.schema.fields}
        for c in out_cols[2:]:
            empty = empty.withColumn(c, F.lit(None).cast(fields[c]))
        return empty
    x0, y0 = min(lx0, rx0), min(ly0, ry0)
    size = max(max(lx1, rx1) - x0, max(ly1, ry1) - y0) * (1 + 1e-9) + 1e-9
    deepest = min(DEEPEST, max(START_LEVEL, math.ceil(math.log(n_right, 4)) + 4))
    px, py = F.col(x), F.col(y)

    def nearest_of(items: str) -> Column:
        return F.array_min(F.transform(items, lambda i: F.struct(
            item_distance(px, py, i).alias("dist"), i[order].alias(order),
            *[i[c].alias(c) for c in payload if c != order])))

    if n_right <= SMALL_ITEMS:
        level, items = _small_candidates(right, item_cols, n_right, x0, y0, size)
        cell = size / 2**level
        probe = left.withColumn("ax", F.floor((px - F.lit(x0)) / F.lit(cell))).withColumn(
            "ay", F.floor((py - F.lit(y0)) / F.lit(cell)))
        return probe.join(F.broadcast(items), ["ax", "ay"]).select(left_id, nearest_of("items").alias("_b")).select(
            left_id, *[f"_b.{c}" for c in out_cols[1:]])
    grid = float(2**deepest)

    def key(c: Column, origin: float) -> Column:
        return F.floor((c - F.lit(origin)) / F.lit(size) * F.lit(grid)).cast("long")

    lk = left.withColumn("ax", key(F.col(x), x0)).withColumn("ay", key(F.col(y), y0))
    rk = right.withColumn("bx", key(F.col("rx"), x0)).withColumn("by", key(F.col("ry"), y0))
    rcells = materialize(rk.groupBy("bx", "by").agg(
        F.count("*").alias("n"), F.max("reach").alias("reach"), F.min(F.struct("rx", "ry")).alias("spot"), F.min("rx").alias("rx0"),
        F.min("ry").alias("ry0"), F.max("rx").alias("rx1"), F.max("ry").alias("ry1")), "nearest-right")
    done = _candidate_cells(lk, rcells, deepest, x0, y0, size)

    def least(rows: DataFrame) -> DataFrame:
        """Best item of each left point; rows of one point are reduced before the shuffle."""
        i = F.col("item")
        scored = rows.select(left_id, F.struct(item_distance(px, py, i).alias("dist"), i[order].alias(order),
                                               *[i[c].alias(c) for c in payload if c != order]).alias("_b"))
        return scored.groupBy(left_id).agg(F.min("_b").alias("_b")).select(left_id, *[f"_b.{c}" for c in out_cols[1:]])

    parts = []
    few = [(lv, rv, p) for lv, rv, p, is_few in done if is_few]
    if few:
        keys, items, cells = ["lv", "ax", "ay", "part"], None, None
        chunks = F.ceil(F.col("m") / F.lit(NEAR_POINTS)).cast("int")
        for lv, rv, pairs in few:
            at = _cells_at(rk, deepest, rv, "b").select("bx", "by", "reach", *item_cols)
            one = pairs.join(at, ["bx", "by"]).withColumn("part", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("lv", F.lit(lv)).select(
                *keys, "reach", *item_cols)
            own = pairs.select(F.lit(lv).alias("lv"), "ax", "ay", chunks.alias("chunks")).distinct()
            items, cells = (one, own) if items is None else (items.unionByName(one), cells.unionByName(own))
        levels = F.array(*[
            F.struct(F.lit(lv).alias("lv"), F.shiftright("ax", deepest - lv).alias("ax"),
                     F.shiftright("ay", deepest - lv).alias("ay")) for lv, _, _ in few])
        placed = lk.withColumn("_l", F.explode(levels)).select(F.col(left_id).alias("_id"), F.col(x).alias("_x"), F.col(y).alias("_y"), "_l.*")
        # a point lies in one finished cell; cells are few and thin, their points are dealt into parts
        probe = placed.join(materialize(cells, "nearest-done"), ["lv", "ax", "ay"]).withColumn(
            "part", F.pmod(F.xxhash64("_id"), F.col("chunks")).cast("int")).select(*keys, "_id", "_x", "_y")
        lists = _near_lists(probe, items, keys, item_cols, segment or ["rx", "ry"], bool(segment), size * 1e-9).select(
            F.col("_id").alias(left_id), F.col("_x").alias(x), F.col("_y").alias(y), "items")
        parts.append(lists.select(left_id, nearest_of("items").alias("_b")).select(left_id, *[f"_b.{c}" for c in out_cols[1:]]))
    for lv, rv, pairs, is_few in done:
        if is_few:
            continue
        probe = _cells_at(lk, deepest, lv, "a").select(left_id, x, y, "ax", "ay")
        at = _cells_at(rk, deepest, rv, "b").select("bx", "by", F.struct(*item_cols).alias("item"))
        near = salted_join(probe, pairs.select("ax", "ay", "bx", "by"), ["ax", "ay"], left_id)
        full = salted_join(near, at, ["bx", "by"], left_id)
        parts.append(least(full))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _near_lists(probe: DataFrame, items: DataFrame, keys: list[str], item_cols: list[str], place: list[str], exact: bool,
                eps: float) -> DataFrame:
    """Points (_id, _x, _y) with ``items``, the list of the items of their cell that can be nearest to them."""
    kinds = {f.name: f for f in items.schema.fields}
    listed = T.ArrayType(T.StructType([kinds[c] for c in item_cols]))
    schema = T.StructType([*probe.select("_id", "_x", "_y").schema.fields, T.StructField("items", listed)])
    out = to_arrow_schema(schema)

    def weigh(points: pa.Table, found: pa.Table) -> pa.Table:
        if not points.num_rows or not found.num_rows:
            return out.empty_table()
        number = lambda t, c: t[c].to_numpy().astype(float)
        at = np.stack([number(found, c) for c in place], axis=1)
        at = at if at.shape[1] == 4 else np.hstack([at, np.zeros_like(at)])
        margin = eps if exact else eps + float(number(found, "reach").max())
        got = list(near_items(number(points, "_x"), number(points, "_y"), at, margin))
        i, j = (np.concatenate(v) for v in zip(*got, strict=True))
        order = np.argsort(i, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=points.num_rows))])
        kept = found.select(item_cols).take(pa.array(j[order])).cast(pa.schema(list(out.field("items").type.value_type))).combine_chunks()
        flat = pa.StructArray.from_arrays([kept[c].combine_chunks() for c in item_cols], fields=list(out.field("items").type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=out.field("items").type)
        return pa.table([*[points[c] for c in ("_id", "_x", "_y")], lists], schema=out)

    ship_package(probe.sparkSession)
    return probe.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInArrow(weigh, schema)


def nearest_point(left: DataFrame, points: DataFrame, left_id: str, x: str, y: str, px: str, py: str,
                  order: str, payload: list[str]) -> DataFrame:
    """Nearest point item. Items at one location are first reduced to the least id."""
    cols = [c for c in dict.fromkeys(payload) if c != order]
    uniq = (
        points.groupBy(F.col(px).alias("rx"), F.col(py).alias("ry"))
        .agg(F.min(F.struct(order, *cols)).alias("_p"))
        .select("rx", "ry", *[f"_p.{c}" for c in [order, *cols]])
    )
    return nearest_join(left, uniq, left_id, x, y,
                        lambda ax, ay, i: G.distance(ax, ay, i["rx"], i["ry"]), order, cols)


def line_pieces(lines: DataFrame, line_id: str, line: str, max_len: float) -> DataFrame:
    """Segments of each line, long ones represented by several pieces. Of equal segments the least id stays.

    Each piece keeps the end points of its whole segment (x1..y2), so the exact
    distance does not depend on the cutting; rx, ry is the piece's middle and
    ``reach`` half its length.
    """
    seg = lines.select(line_id, F.explode(G.ring_edges(F.col(line))).alias("e")).select(line_id, "e.*")
    seg = seg.groupBy("x1", "y1", "x2", "y2").agg(F.min(line_id).alias(line_id))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    return (
        seg.withColumn("_n", F.greatest(F.ceil(length / F.lit(max_len)), F.lit(1)).cast("int"))
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_t", (F.col("_k") + F.lit(0.5)) / F.col("_n"))
        .withColumn("rx", F.col("x1") + F.col("_t") * dx)
        .withColumn("ry", F.col("y1") + F.col("_t") * dy)
        .withColumn("reach", length / F.col("_n") / 2.0 + F.lit(1e-6))
        .drop("_n", "_k", "_t")
    )


def nearest_line(left: DataFrame, lines: DataFrame, left_id: str, x: str, y: str, line_id: str, line: str,
                 max_piece: float = 1500.0) -> DataFrame:
    """Least distance from each point to any line; ties by line id."""
    pieces = line_pieces(lines, line_id, line, max_piece)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pieces = pieces.withColumn("dx", dx).withColumn("dy", dy).withColumn("len2", F.nullif(dx * dx + dy * dy, F.lit(0.0)))

    def to_segment(px, py, i):
        ahead = ((px - i["x1"]) * i["dx"] + (py - i["y1"]) * i["dy"]) / i["len2"]
        t = F.least(F.greatest(F.coalesce(ahead, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.hypot(px - (i["x1"] + t * i["dx"]), py - (i["y1"] + t * i["dy"]))

    return nearest_join(left, pieces, left_id, x, y, to_segment, line_id, [], "reach",
                        ["x1", "y1", "dx", "dy", "len2"], ["x1", "y1", "dx", "dy"])


# --- radius totals -------------------------------------------------------------

#: Centres and item locations of one block that are worked on at once.
CIRCLE_CENTRES, CIRCLE_ITEMS = 1 << 17, 1 << 20


def radius_totals(centres: DataFrame, items: DataFrame, radius: float, centre_id: str,
                  value: str, crowded: int = 512) -> DataFrame:
    """Per centre (cx, cy): count and sum of ``value`` of items (ix, iy) within radius.

    Items are reduced to distinct locations first. Centres lie in one block of a grid, items in all blocks that their
    circles meet; neither is ever listed for one another. A block is worked on in Arrow batches, where running totals
    over strips give what lies in a circle for sure and only locations along its edge are tested one by one (see
    ``circle_totals``). Blocks of many centres or items are dealt out in parts. Centres with nothing near get 0.
    """
    def usable(x: str, y: str) -> Column:
        return F.coalesce((F.abs(x) < F.lit(float("inf"))) & (F.abs(y) < F.lit(float("inf"))), F.lit(False))

    spots = materialize(
        items.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("s")), "radius-items").filter(usable("ix", "iy"))
    centres = materialize(centres.select(centre_id, "cx", "cy"), "radius-centres", deal=True)
    side, keys = 2.0 * radius, ["bx", "by"]

    def at(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.withColumn("bx", F.floor(F.col(x) / F.lit(side))).withColumn("by", F.floor(F.col(y) / F.lit(side)))

    def around(c: str) -> Column:
        reach = F.lit(radius * (1 + 1e-6))
        return F.sequence(F.floor((F.col(c) - reach) / F.lit(side)), F.floor((F.col(c) + reach) / F.lit(side)))

    near = spots.withColumn("bx", F.explode(around("ix"))).withColumn("by", F.explode(around("iy"))).select(*keys, "ix", "iy", "n", "s")
    known = centres.filter(usable("cx", "cy"))

    def parts(df: DataFrame, most: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name))

    blocks = materialize(parts(at(known, "cx", "cy"), CIRCLE_CENTRES, "c_parts").join(parts(near, CIRCLE_ITEMS, "i_parts"), keys), "radius-blocks")
    split = (blocks.agg(F.max("i_parts")).first()[0] or 1) > 1
    # where a block's items come in parts, their totals are added up for each place
    where = known.select("cx", "cy").distinct() if split else known
    kept = [c for c in where.columns if c not in ("cx", "cy")]

    def dealt(df: DataFrame, own: str, other: str, by: list[str]) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))
        return df.join(blocks, keys).withColumn(own, F.pmod(F.xxhash64(*by), F.col(f"{own}_parts")).cast("int")).withColumn(
            other, every).drop("c_parts", "i_parts")

    cells = [*keys, "c", "i"]
    schema = T.StructType([*where.select(*kept, "cx", "cy").schema.fields, T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())])
    out = to_arrow_schema(schema)

    def add_up(points: pa.Table, found: pa.Table) -> pa.Table:
        if not points.num_rows or not found.num_rows:
            return out.empty_table()
        number = lambda t, c: t[c].fill_null(0).to_numpy().astype(float)
        n, s = circle_totals(number(points, "cx"), number(points, "cy"), number(found, "ix"), number(found, "iy"),
                             found["n"].to_numpy(), number(found, "s"), radius, crowded)
        return pa.table([*[points[c] for c in out.names[:-2]], pa.array(n), pa.array(s)], schema=out)

    ship_package(centres.sparkSession)
    # copies of one place count as often as they come, so they are dealt by their id where ids are kept
    lhs = dealt(at(where, "cx", "cy"), "c", "i", kept or ["cx", "cy"]).select(*cells, *kept, "cx", "cy")
    sums = lhs.groupBy(*cells).cogroup(dealt(near, "i", "c", ["ix", "iy"]).groupBy(*cells)).applyInArrow(add_up, schema)
    found = lambda n, s: (F.coalesce(n, F.lit(0)).cast("long").alias("n_within"), F.coalesce(s, F.lit(0.0)).alias("sum_within"))
    if split:
        sums = sums.groupBy(F.col("cx").alias("px"), F.col("cy").alias("py")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return centres.join(sums, (F.col("cx") == F.col("px")) & (F.col("cy") == F.col("py")), "left").select(centre_id, *found("n", "s"))
    apart = at(centres.withColumn("known", usable("cx", "cy")), "cx", "cy").withColumn("bx", F.when(F.col("known"), F.col("bx"))).join(
        blocks, keys, "left_anti").select(centre_id, *found(F.lit(0), F.lit(0.0)))
    return sums.select(centre_id, *found("n", "s")).unionByName(apart)


# --- clipping ------------------------------------------------------------------

def boundary_pieces(boundary: DataFrame, parts: str = "parts") -> DataFrame:
    """Convex pieces (ring, bbox) of a boundary table."""
    return (
        boundary.select(F.explode(G.convex_pieces(G.edges(F.col(parts)))).alias("window"))
        .filter(G.ring_area2(F.col("window")) > 0)
        .withColumn("bbox", G.bbox_of(F.col("window")))
    )


def clip_points(points: DataFrame, boundary: DataFrame, cell: float, x: str, y: str, point_id: str) -> DataFrame:
    """Points inside or on the boundary of any boundary polygon, each once.

    Where the boundary meets few cells, a point is looked up by its own cell and settled where it is: one in a cell
    wholly inside by that alone, others by the edges of the pieces there. No rows are paired, shuffled or counted again.
    """
    cut, _ = FR.pieces(boundary.select("bbox", "edges", F.array().cast(f"array<{G.POINT_T}>").alias("anchors")))
    b = F.col("bbox")
    cells = FR.cover_cells(cut)
    if small_side(cells, F.size("edges")) and cut.filter(F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]) <= 0).isEmpty():
        cells = materialize(cells.select("lv", "cx", "cy", "full", *[F.col(c).alias(f"_w_{c}") for c in ("bbox", "edges", "ref")]), "boundary-cells")
        found, rest = points.limit(0), points
        px, py, box = F.col(x), F.col(y), F.col("_w_bbox")
        for lv in FR.levels_of(cells):
            size = F.lit(2.0**lv)
            here = F.broadcast(cells.filter(F.col("lv") == lv))
            held = ((F.floor(px / size) == F.col("cx")) & (F.floor(py / size) == F.col("cy")) & (F.col("full") | (
                px.between(box["xmin"], box["xmax"]) & py.between(box["ymin"], box["ymax"]) & FR.piece_contains(px, py, "_w_", False))))
            found = found.unionByName(rest.join(here, held, "left_semi"))
            rest = rest.join(here, held, "left_anti")
        return found
    hits = points_in_polygons(points.select(point_id, x, y), boundary.select("bbox", "edges"),
                              cell, x, y, point_id, strict=False)
    return points.join(hits.select(point_id).distinct(), point_id, "left_semi")


def clip_polygons(features: DataFrame, boundary: DataFrame, cell: float, feature_id: str, parts: str = "parts") -> DataFrame:
    """Polygons cut to the boundary; those left with no area are dropped."""
    windows = boundary_pieces(boundary)
    small = features.select(feature_id, parts, G.bbox(F.col(parts)).alias("bbox"))
    cut = (
        overlap_join(small, windows, cell, feature_id)
        .select(feature_id, F.explode(G.clip_parts(F.col(parts), F.col("r_window"))).alias("_p"))
        .groupBy(feature_id).agg(F.collect_list("_p").alias("_parts"))
    )
    rest = [c for c in features.columns if c not in (feature_id, parts)]
    return features.select(feature_id, *rest).join(cut.withColumnRenamed("_parts", parts), feature_id)


def clip_lines(lines: DataFrame, boundary: DataFrame, cell: float, line_id: str, line: str) -> DataFrame:
    """Lines cut to the boundary, as ``pieces``: array of point arrays in order.

    Every segment is cut where it crosses a boundary edge and the parts whose
    middle lies inside are kept; adjoining parts are joined again.
    """
    seg = (
        lines.select(line_id, F.posexplode(G.ring_edges(F.col(line))).alias("seq", "e"))
        .withColumn("bbox", F.struct(
            F.least("e.x1", "e.x2").alias("xmin"), F.least("e.y1", "e.y2").alias("ymin"),
            F.greatest("e.x1", "e.x2").alias("xmax"), F.greatest("e.y1", "e.y2").alias("ymax")))
        .withColumn("_sid", F.xxhash64(line_id, "seq"))
    )
    e = F.col("e")
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]

    def cut_at(b):
        ex, ey = b["x2"] - b["x1"], b["y2"] - b["y1"]
        den = F.nullif(dx * ey - dy * ex, F.lit(0.0))
        t = ((b["x1"] - e["x1"]) * ey - (b["y1"] - e["y1"]) * ex) / den
        u = ((b["x1"] - e["x1"]) * dy - (b["y1"] - e["y1"]) * dx) / den
        return F.when((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    cuts = F.array_sort(F.array_distinct(F.concat(
        F.array(F.lit(0.0), F.lit(1.0)),
        F.filter(F.transform("r_edges", cut_at), lambda t: t.isNotNull()))))

    def keep(t, i):
        nxt = F.get(F.col("_t"), i + 1)
        mid = (t + nxt) / 2.0
        inside = covers_mid(e["x1"] + mid * dx, e["y1"] + mid * dy)
        return F.when(nxt.isNotNull() & inside, F.struct(t.alias("t0"), nxt.alias("t1")))

    def covers_mid(mx, my):
        return G.covers(mx, my, F.col("r_edges"))

    def at(t):
        return F.when(t == 0, G.point(e["x1"], e["y1"])).when(t == 1, G.point(e["x2"], e["y2"])).otherwise(
            G.point(e["x1"] + t * dx, e["y1"] + t * dy))

    kept = (
        overlap_join(seg, boundary.select("bbox", "edges"), cell, "_sid")
        .withColumn("_t", cuts)
        .withColumn("_k", F.explode(F.filter(F.transform("_t", keep), lambda k: k.isNotNull())))
        .select(line_id, F.struct(
            F.col("seq").alias("seq"), F.col("_k.t0").alias("t0"), F.col("_k.t1").alias("t1"),
            at(F.col("_k.t0")).alias("a"), at(F.col("_k.t1")).alias("b")).alias("s"))
        .groupBy(line_id).agg(F.array_sort(F.collect_list("s")).alias("ss"))
    )

    def grow(acc, s):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.element_at(F.coalesce(last, F.array(s["a"])), -1) == s["a"])
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(F.concat(last, F.array(s["b"]))))).otherwise(
            F.concat(acc, F.array(F.array(s["a"], s["b"]))))

    pieces = kept.select(line_id, F.aggregate(
        F.col("ss"), F.array().cast(f"array<{G.RING_T}>"),
        lambda acc, s: F.when(F.size(acc) == 0, F.array(F.array(s["a"], s["b"]))).otherwise(grow(acc, s)),
    ).alias("pieces"))
    rest = [c for c in lines.columns if c not in (line_id, line)]
    return lines.select(line_id, *rest).join(pieces, line_id)
