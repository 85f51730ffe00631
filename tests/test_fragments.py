"""Polygons cut into cell fragments, against whole edge arrays."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from landsieve.functions import geometry as G
from landsieve.operators import enrich as E
from landsieve.operators import fragments as FR
from landsieve.operators import spatial as S
from landsieve.session import materialize

RINGS = "id long, rings array<array<array<double>>>"


def layer(spark, rows):
    """Polygons from rows (id, rings); several rings of one id are an outer ring with its holes."""
    df = spark.createDataFrame([(i, [[[float(v) for v in p] for p in r] for r in rs]) for i, rs in rows], RINGS)
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: G.point(p[0], p[1])))
    return S.polygon_columns(df.withColumn("parts", F.array(F.struct(rings.alias("rings"))))).drop("rings")


def wavy(n, cx=0.0, cy=0.0, r=1.0, waves=9, depth=0.3, turn=0.0):
    pts = [(cx + (r + r * depth * math.sin(waves * t)) * math.cos(t + turn), cy + (r + r * depth * math.sin(waves * t)) * math.sin(t + turn))
           for t in (2 * math.pi * i / n for i in range(n))]
    return [list(p) for p in (*pts, pts[0])]


def box(x, y, w, h=None):
    h = w if h is None else h
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


def edges_of(rings):
    return np.array([(*a, *b) for r in rings for a, b in zip(r, r[1:], strict=False)])


def meets_box(es, x, y, w):
    """Whether a polygon given by edges shares a point with a square, by all edges."""
    px, py = x, y
    up = (es[:, 1] > py) != (es[:, 3] > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (es[:, 2] - es[:, 0]) * (py - es[:, 1]) / (es[:, 3] - es[:, 1]) + es[:, 0]
    inside = (up & (px < cross)).sum() % 2 == 1
    vertex = ((es[:, 0] >= x) & (es[:, 0] <= x + w) & (es[:, 1] >= y) & (es[:, 1] <= y + w)).any()
    dx, dy = es[:, 2] - es[:, 0], es[:, 3] - es[:, 1]
    corners = [dx * (qy - es[:, 1]) - dy * (qx - es[:, 0]) for qx, qy in ((x, y), (x + w, y), (x, y + w), (x + w, y + w))]
    split = (np.min(corners, axis=0) <= 0) & (np.max(corners, axis=0) >= 0)
    near = ((np.minimum(es[:, 0], es[:, 2]) <= x + w) & (np.maximum(es[:, 0], es[:, 2]) >= x)
            & (np.minimum(es[:, 1], es[:, 3]) <= y + w) & (np.maximum(es[:, 1], es[:, 3]) >= y))
    return bool(inside or vertex or (split & near).any())


def pairs(spark, a, b, cell=0.3):
    got = S.intersecting(layer(spark, a), layer(spark, b), cell, right_id="id", cut_left=True)
    return sorted((r["id"], r["r_id"]) for r in got.select("id", "r_id").collect())


def whole(spark, a, b):
    x, y = layer(spark, a), layer(spark, b)
    y = y.select(*[F.col(c).alias(f"r_{c}") for c in y.columns])
    hit = G.polygons_intersect(F.col("edges"), F.col("anchors"), F.col("r_edges"), F.col("r_anchors"))
    return sorted((r["id"], r["r_id"]) for r in x.crossJoin(y).filter(hit).select("id", "r_id").collect())


def test_pairs_equal_whole_edges(spark):
    """Large with small, large with large, holes, nested polygons, aligned boxes."""
    rng = random.Random(1)
    large = [(1, [wavy(300)]), (2, [wavy(250, 0.2, 0.1, 2.0, 5), wavy(100, 0.2, 0.1, 0.9, 3, 0.1)[::-1]]), (3, [wavy(130, 3, 3, 0.5)]),
             (4, [wavy(150, 0.0, 0.0, 0.2, 12, 0.5)]), (5, [[[i / 40, 0.0] for i in range(81)] + [[2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]])]
    small = [(i, [box(rng.uniform(-3, 4), rng.uniform(-3, 4), rng.choice([0.01, 0.1, 0.6]))]) for i in range(50)]
    small += [(200 + 8 * j + i, [box(i / 4 - 1, j / 4 - 1, 0.25)]) for i in range(8) for j in (0, 3, 7)]
    small += [(300, [box(0.1, 0.1, 0.001)]), (301, [box(-50, -50, 100)]), (302, [wavy(90, 0, 0, 0.05)])]
    assert pairs(spark, large, small) == whole(spark, large, small)
    assert pairs(spark, small, large) == whole(spark, small, large)
    assert pairs(spark, large, large) == whole(spark, large, large)


def test_one_polygon_of_200_000_vertices(spark):
    """Crowded parcels against it equal brute force; no piece holds many edges, and a test reads two pieces."""
    ring = wavy(200_000, -118.5, 35.2, 0.2, 400, 0.05)
    rng = random.Random(2)
    at = [(rng.gauss(-118.5, 0.15), rng.gauss(35.2, 0.15)) for _ in range(500)]
    boxes = [(i, x, y, rng.choice([0.0002, 0.001, 0.004])) for i, (x, y) in enumerate(at)]
    flat = spark.createDataFrame([(1, [c for p in ring for c in p])], "id long, xy array<double>")
    points = F.transform(F.sequence(F.lit(0), F.lit(len(ring) - 1)), lambda i: G.point(F.col("xy")[i * 2], F.col("xy")[i * 2 + 1]))
    flood = materialize(S.polygon_columns(flat.select("id", G.polygon(points).alias("parts"))), "flood")
    parcels = S.polygon_columns(spark.createDataFrame(boxes, "id long, x double, y double, w double").select(
        "id", G.box_polygon(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")).alias("parts")))
    es = edges_of([ring])
    want = {i for i, x, y, w in boxes if meets_box(es, x, y, w)}
    assert 80 < len(want) < 420
    assert {r["id"] for r in E.flood_flag(parcels, flood).collect()} == want

    cut, divided = FR.pieces(flood.select("id", "bbox", "edges", "anchors"))
    sizes = cut.select(F.size("edges").alias("n"), F.col("ref.inside").alias("solid")).toPandas()
    assert divided and sizes["n"].max() <= FR.MAX_EDGES and sizes["solid"][sizes["n"] == 0].all()
    assert sizes["n"].sum() < 3 * 200_000 and len(sizes) < 60_000
    tested = S.overlap_join(FR.pieces(parcels.select("id", "bbox", "edges", "anchors"))[0], cut, E.OVERLAY_CELL).agg(
        F.max(F.size("edges") + F.size("r_edges")).alias("most"), F.count("*").alias("n")).first()
    assert tested["most"] <= FR.MAX_EDGES + 4 and tested["n"] < 40 * len(boxes)


def test_points_equal_whole_edges(spark):
    rng = random.Random(3)
    polygons = layer(spark, [(1, [wavy(600)]), (2, [wavy(300, 0, 0, 2.0), wavy(400, 0, 0, 0.5)[::-1]]), (3, [box(0, 0, 1)]),
                             (4, [[[i / 40, 0.0] for i in range(81)] + [[2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]])])
    at = [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(400)] + [(i / 8, j / 8) for i in range(-8, 17) for j in range(0, 17, 2)]
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id long, x double, y double")
    for strict, test in ((True, G.contains_strict), (False, G.covers)):
        got = S.points_in_polygons(pts, polygons.select(F.col("id").alias("pid"), "bbox", "edges"), 0.3, "x", "y", strict=strict)
        every = pts.crossJoin(polygons.select(F.col("id").alias("r_pid"), "edges")).filter(test(F.col("x"), F.col("y"), F.col("edges")))
        assert {(r["id"], r["r_pid"]) for r in got.collect()} == {(r["id"], r["r_pid"]) for r in every.collect()}


def test_edges_that_dividing_doesn_t_part(spark):
    """Edges that lie on one another, or all meet in one point, end in pieces all the same."""
    fan = [[0.0, 0.0]]
    for i in range(60):
        fan += [[math.cos(i / 20), math.sin(i / 20)], [0.0, 0.0]]
    comb = [[0.0, 0.0], *[[float(i % 2), 0.5] for i in range(100)], [0.0, 1.0], [0.0, 0.0]]
    polygons = layer(spark, [(1, [fan]), (2, [comb])])
    cut, _ = FR.pieces(polygons.select("id", "bbox", "edges", "anchors"))
    assert cut.count() < 60_000
    small = [(i, [box(x / 5 - 1, y / 5 - 1, 0.1)]) for i, (x, y) in enumerate((x, y) for x in range(0, 11, 2) for y in range(0, 11, 2))]
    both = [(1, [fan]), (2, [comb])]
    assert pairs(spark, both, small) == whole(spark, both, small)


def test_small_and_empty_layers_are_left_whole(spark):
    p = layer(spark, [(1, [box(0, 0, 1)]), (2, [])]).select("id", "bbox", "edges", "anchors")
    cut, divided = FR.pieces(p)
    assert not divided and cut.count() == 2
    assert pairs(spark, [(1, [box(0, 0, 1)])], [(2, [])]) == []
