"""Geometry measures and tests as Columns.

point    : two double columns x, y
line     : array<struct<x,y>>
polygon  : parts array<struct<rings array<array<struct<x,y>>>>>, ring 0 is the
           outer ring, the others are holes; rings are closed.
edges    : array<struct<x1,y1,x2,y2>>, all edges of all rings of a polygon;
           joins carry this column so it is derived once per feature.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT_T = "struct<x:double,y:double>"
RING_T = f"array<{POINT_T}>"
PARTS_T = f"array<struct<rings:array<{RING_T}>>>"
BBOX_T = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
EDGE_T = "struct<x1:double,y1:double,x2:double,y2:double>"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body(v)``."""
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed ring of a box, counter-clockwise from the lower left."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def polygon(*rings: Column) -> Column:
    """A one-part polygon; the first ring is the outer one."""
    return F.array(F.struct(F.array(*rings).alias("rings")))


def box_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return polygon(box_ring(x0, y0, x1, y1))


def ring_edges(ring: Column) -> Column:
    m = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, F.lit(1), m), F.slice(ring, F.lit(2), m),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def rings(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda p: p["rings"]))


def edges(parts: Column) -> Column:
    return F.flatten(F.transform(rings(parts), ring_edges))


def vertices(parts: Column) -> Column:
    return F.flatten(rings(parts))


def vertex_count(parts: Column) -> Column:
    return F.size(vertices(parts))


def bbox_of(points: Column) -> Column:
    """Bounding box of an array of points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    )


def bbox(parts: Column) -> Column:
    return bbox_of(vertices(parts))


def point_bbox(x: Column, y: Column) -> Column:
    return F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))


def bbox_overlaps(a: Column, b: Column) -> Column:
    return (
        (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"])
        & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])
    )


def map_points(parts: Column, fn) -> Column:
    """Apply ``fn(x, y)`` to each vertex; it returns a pair or an (x, y) struct."""
    def one(p):
        out = fn(p["x"], p["y"])
        return point(*out) if isinstance(out, tuple) else out

    return F.transform(
        parts,
        lambda part: F.struct(
            F.transform(part["rings"], lambda r: F.transform(r, one)).alias("rings")
        ),
    )


def round_coords(parts: Column, digits: int = 6) -> Column:
    return map_points(parts, lambda x, y: (F.round(x, digits), F.round(y, digits)))


def ring_area2(ring: Column) -> Column:
    """Twice the signed area. Coordinates are taken relative to the first vertex."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    return F.aggregate(
        ring_edges(ring), F.lit(0.0),
        lambda acc, e: acc + (e["x1"] - ox) * (e["y2"] - oy) - (e["x2"] - ox) * (e["y1"] - oy),
    )


def area(parts: Column) -> Column:
    """Planar area: outer rings minus holes."""
    def part_area(p):
        return F.aggregate(
            F.slice(p["rings"], F.lit(2), F.greatest(F.size(p["rings"]) - 1, F.lit(0))),
            F.abs(ring_area2(p["rings"][0])),
            lambda acc, hole: acc - F.abs(ring_area2(hole)),
        )

    return F.aggregate(F.transform(parts, part_area), F.lit(0.0), lambda a, v: a + v) / 2.0


def centroid(parts: Column) -> Column:
    """Area-weighted centroid. Holes count negatively whatever their winding."""
    o = parts[0]["rings"][0][0]

    def ring_moments(ring, sign):
        orient = F.when(ring_area2(ring) < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * sign
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def step(acc, e):
            x1, y1, x2, y2 = e["x1"] - o["x"], e["y1"] - o["y"], e["x2"] - o["x"], e["y2"] - o["y"]
            c = x1 * y2 - x2 * y1
            return F.struct(
                (acc["a"] + c).alias("a"),
                (acc["x"] + (x1 + x2) * c).alias("x"),
                (acc["y"] + (y1 + y2) * c).alias("y"),
            )

        # The winding decides the sign of the whole sum, so it is applied once at the end.
        return let(F.struct(orient.alias("k"), F.aggregate(ring_edges(ring), zero, step).alias("m")), lambda v: F.struct(
            *[(v["m"][n] * v["k"]).alias(n) for n in ("a", "x", "y")]))

    moments = F.flatten(F.transform(
        parts,
        lambda p: F.transform(
            p["rings"], lambda r, i: ring_moments(r, F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
        ),
    ))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(
        moments, zero,
        lambda acc, m: F.struct(
            (acc["a"] + m["a"]).alias("a"), (acc["x"] + m["x"]).alias("x"), (acc["y"] + m["y"]).alias("y")
        ),
        lambda acc: F.when(
            acc["a"] != 0,
            F.struct((acc["x"] / (acc["a"] * 3.0)).alias("x"), (acc["y"] / (acc["a"] * 3.0)).alias("y")),
        ),
    )
    return let(total, lambda t: F.when(t.isNotNull(), point(o["x"] + t["x"], o["y"] + t["y"])))


def _crossings(px: Column, py: Column, es: Column) -> Column:
    """Even-odd parity of a ray to the right: true when inside."""
    return F.aggregate(
        es, F.lit(False),
        lambda acc, e: acc != (
            ((e["y1"] > py) != (e["y2"] > py))
            & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
        ).eqNullSafe(True),
    )


def on_edge(px: Column, py: Column, es: Column) -> Column:
    return F.exists(
        es,
        lambda e: ((e["x2"] - e["x1"]) * (py - e["y1"]) == (e["y2"] - e["y1"]) * (px - e["x1"]))
        & (px >= F.least(e["x1"], e["x2"])) & (px <= F.greatest(e["x1"], e["x2"]))
        & (py >= F.least(e["y1"], e["y2"])) & (py <= F.greatest(e["y1"], e["y2"])),
    )


def contains_strict(px: Column, py: Column, es: Column) -> Column:
    """Point strictly inside; on the boundary is not inside."""
    return _crossings(px, py, es) & ~on_edge(px, py, es)


def covers(px: Column, py: Column, es: Column) -> Column:
    """Point inside or on the boundary."""
    return _crossings(px, py, es) | on_edge(px, py, es)


def _side(ax, ay, bx, by, px, py) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_touch(a: Column, b: Column) -> Column:
    """Closed segments share at least one point."""
    d1 = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"])
    d2 = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    d3 = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"])
    d4 = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    boxes = (
        (F.least(a["x1"], a["x2"]) <= F.greatest(b["x1"], b["x2"]))
        & (F.greatest(a["x1"], a["x2"]) >= F.least(b["x1"], b["x2"]))
        & (F.least(a["y1"], a["y2"]) <= F.greatest(b["y1"], b["y2"]))
        & (F.greatest(a["y1"], a["y2"]) >= F.least(b["y1"], b["y2"]))
    )
    return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def segments_cross(a: Column, b: Column) -> Column:
    """Segments cross in an interior point of both."""
    d1 = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"])
    d2 = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    d3 = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"])
    d4 = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def anchors(parts: Column) -> Column:
    """One vertex per part, enough to settle containment when no edges meet."""
    return F.transform(parts, lambda p: p["rings"][0][0])


def polygons_intersect(edges_a: Column, anchors_a: Column, edges_b: Column, anchors_b: Column) -> Column:
    """Closed polygons share at least one point."""
    return (
        F.exists(anchors_a, lambda p: covers(p["x"], p["y"], edges_b))
        | F.exists(anchors_b, lambda p: covers(p["x"], p["y"], edges_a))
        | F.exists(edges_a, lambda a: F.exists(edges_b, lambda b: segments_touch(a, b)))
    )


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a closed segment."""
    dx, dy = x2 - x1, y2 - y1
    ahead = ((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.least(F.greatest(F.coalesce(ahead, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return let(t, lambda t: F.hypot(px - (x1 + t * dx), py - (y1 + t * dy)))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def line_distance(px: Column, py: Column, line: Column) -> Column:
    return F.array_min(F.transform(
        ring_edges(line), lambda e: segment_distance(px, py, e["x1"], e["y1"], e["x2"], e["y2"])
    ))


def geometry_problem(parts: Column) -> Column:
    """NULL for a valid polygon, else what is wrong with it."""
    empty = parts.isNull() | (F.size(parts) == 0) | (F.coalesce(vertex_count(parts), F.lit(0)) == 0)
    short = F.exists(rings(parts), lambda r: F.size(r) < 4)
    opened = F.exists(rings(parts), lambda r: (r[0]["x"] != r[F.size(r) - 1]["x"]) | (r[0]["y"] != r[F.size(r) - 1]["y"]))
    es = edges(parts)
    selfcross = F.exists(es, lambda a: F.exists(es, lambda b: segments_cross(a, b)))
    return (
        F.when(empty, F.lit("empty"))
        .when(short, F.lit("too few points"))
        .when(opened, F.lit("not closed"))
        .when(selfcross, F.lit("self-crossing"))
    )


def half_plane_clip(ring: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Keep the part of a closed ring on the left of the directed line 1 -> 2."""
    none = F.array().cast(RING_T)

    def side(x, y):
        return (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)

    def piece(e):
        def kept(v):
            b = point(e["x2"], e["y2"])
            t = v["a"] / F.nullif(v["a"] - v["b"], F.lit(0.0))
            cut = point(
                F.when(x1 == x2, x1).otherwise(e["x1"] + t * (e["x2"] - e["x1"])),
                F.when(y1 == y2, y1).otherwise(e["y1"] + t * (e["y2"] - e["y1"])),
            )
            return (
                F.when((v["a"] >= 0) & (v["b"] >= 0), F.array(b)).when(v["a"] >= 0, F.array(cut))
                .when(v["b"] >= 0, F.array(cut, b)).otherwise(none)
            )

        return let(F.struct(side(e["x1"], e["y1"]).alias("a"), side(e["x2"], e["y2"]).alias("b")), kept)

    return let(
        F.flatten(F.transform(ring_edges(ring), piece)),
        lambda out: F.when(F.size(out) > 0, F.concat(F.slice(out, F.size(out), 1), out)).otherwise(none),
    )


def clip_ring(ring: Column, window: Column) -> Column:
    """Clip a closed ring to a convex counter-clockwise window ring."""
    return F.aggregate(
        ring_edges(window), ring,
        lambda acc, w: half_plane_clip(acc, w["x1"], w["y1"], w["x2"], w["y2"]),
    )


def clip_parts(parts: Column, window: Column) -> Column:
    """Clip every ring to a convex window; parts of zero area are dropped."""
    def alive(r):
        return (F.size(r) >= 4) & (F.coalesce(F.abs(ring_area2(r)), F.lit(0.0)) > 0)

    clipped = F.transform(parts, lambda p: F.transform(p["rings"], lambda r: clip_ring(r, window)))
    outer = F.filter(clipped, lambda rs: alive(rs[0]))
    return F.transform(outer, lambda rs: F.struct(F.filter(rs, alive).alias("rings")))


def convex_pieces(es: Column) -> Column:
    """Split a polygon, given as edges, into trapezoid rings (counter-clockwise).

    Cuts at the height of every vertex; within one slab the edges that span it,
    taken left to right, bound the pieces pairwise (even-odd).
    """
    ys = F.array_sort(F.array_distinct(F.transform(es, lambda e: e["y1"])))

    def at(e, y):
        slope = (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return (
            F.when(y == e["y1"], e["x1"]).when(y == e["y2"], e["x2"])
            .otherwise(e["x1"] + (y - e["y1"]) * slope)
        )

    def slab(ys, i):
        lo, hi = ys[i], ys[i + 1]
        mid = (lo + hi) / 2.0
        spans = F.filter(es, lambda e: (F.least(e["y1"], e["y2"]) <= lo) & (F.greatest(e["y1"], e["y2"]) >= hi))
        walls = F.array_sort(F.transform(
            spans, lambda e: F.struct(at(e, mid).alias("xm"), at(e, lo).alias("xl"), at(e, hi).alias("xh"))
        ))

        def boxes(ws):
            n = (F.size(ws) / 2).cast("int")
            return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.array(
                point(ws[j * 2]["xl"], lo), point(ws[j * 2 + 1]["xl"], lo),
                point(ws[j * 2 + 1]["xh"], hi), point(ws[j * 2]["xh"], hi), point(ws[j * 2]["xl"], lo),
            ))).otherwise(F.array().cast(f"array<{RING_T}>"))

        return let(walls, boxes)

    return let(ys, lambda v: F.when(
        F.size(v) > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.size(v) - 2), lambda i: slab(v, i)))
    ).otherwise(F.array().cast(f"array<{RING_T}>")))


def spherical_area(parts: Column, radius: float = 6371008.8) -> Column:
    """Area on a sphere of a lon/lat polygon in square metres."""
    def ring_sphere(r):
        return F.abs(F.aggregate(
            ring_edges(r), F.lit(0.0),
            lambda acc, e: acc + F.radians(e["x2"] - e["x1"])
            * (F.lit(2.0) + F.sin(F.radians(e["y1"])) + F.sin(F.radians(e["y2"]))),
        )) * F.lit(radius * radius / 2.0)

    def part_sphere(p):
        return F.aggregate(
            F.slice(p["rings"], F.lit(2), F.greatest(F.size(p["rings"]) - 1, F.lit(0))),
            ring_sphere(p["rings"][0]), lambda acc, h: acc - ring_sphere(h),
        )

    return F.aggregate(F.transform(parts, part_sphere), F.lit(0.0), lambda a, v: a + v)


def hilbert(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float, bits: int = 16) -> Column:
    """Position along a Hilbert curve of a point in the given box.

    Expects x0 < x1 and y0 < y1. The walk keeps a 4-state orientation
    (``swap`` and ``flip``) instead of rotating coordinates.
    """
    top = (1 << bits) - 1
    def scale(v, lo, hi):
        u = ((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(1 << bits))).cast("long")
        return F.greatest(F.least(u, F.lit(top)), F.lit(0))

    hx, hy = scale(x, x0, x1), scale(y, y0, y1)
    state = F.struct(hx.cast("long").alias("x"), hy.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc, k):
        side = F.lit(1).cast("long") * F.pow(F.lit(2.0), k.cast("double")).cast("long")
        rx = F.when(acc["x"].bitwiseAND(side) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ry = F.when(acc["y"].bitwiseAND(side) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        d = acc["d"] + side * side * ((rx * 3).bitwiseXOR(ry))
        flip = (ry == 0) & (rx == 1)
        fx = F.when(flip, F.lit(top).cast("long") - acc["x"]).otherwise(acc["x"])
        fy = F.when(flip, F.lit(top).cast("long") - acc["y"]).otherwise(acc["y"])
        return F.struct(
            F.when(ry == 0, fy).otherwise(fx).alias("x"),
            F.when(ry == 0, fx).otherwise(fy).alias("y"),
            d.alias("d"),
        )

    return F.aggregate(F.array(*[F.lit(k) for k in range(bits - 1, -1, -1)]), state, step, lambda s: s["d"])
