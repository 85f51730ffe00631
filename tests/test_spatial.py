"""Spatial operators against brute force, with crowded places, and plan shapes."""

import math

import pytest
from pyspark.sql import functions as F

from landsieve.functions import geometry as G
from landsieve.functions import projection as P
from landsieve.operators import joins as J
from landsieve.operators import ordering as O
from landsieve.operators import repair as RP
from landsieve.operators import spatial as S
from landsieve.session import materialize


@pytest.fixture(scope="module")
def points(spark):
    """A third of the points share one spot; a third lie in one small cluster."""
    k = F.col("id")
    crowd = F.when(k % 3 == 0, 500.0).when(k % 3 == 1, 40 + F.rand(1) * 2).otherwise(F.rand(2) * 1000)
    return materialize(spark.range(3000).select("id", crowd.alias("x"), F.when(k % 3 == 0, 500.0).when(k % 3 == 1, 60 + F.rand(3) * 2).otherwise(F.rand(4) * 1000).alias("y")), "pts")


@pytest.fixture(scope="module")
def stations(spark):
    k = F.col("id")
    return materialize(spark.range(1500).select(k.alias("sid"), F.when(k % 3 == 0, 700.0).when(k % 3 == 1, 40 + F.rand(5)).otherwise(F.rand(6) * 1000).alias("px"),
                                                F.when(k % 3 == 0, 10.0).when(k % 3 == 1, 60 + F.rand(7)).otherwise(F.rand(8) * 1000).alias("py")), "st")


def brute(points, stations):
    b = points.join(stations, F.lit(True)).groupBy("id").agg(F.min(F.struct(G.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")).alias("d"), "sid")).alias("b"))
    return {r.id: (r.b.d, r.b.sid) for r in b.collect()}


@pytest.mark.parametrize("small,few,deepest", [(1024, 64, 14), (0, 64, 14), (0, 2, 5)])
def test_nearest(points, stations, monkeypatch, small, few, deepest):
    """Few-items path, grid walk, and the crowded rest at the deepest level."""
    monkeypatch.setattr(S, "SMALL_ITEMS", small)
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "PAIR_BUDGET", few * 64)
    monkeypatch.setattr(S, "DEEPEST", deepest)
    st = stations.filter("sid < 900") if small else stations
    n = S.nearest_point(points, st, "id", "x", "y", "px", "py", "sid", [])
    assert {r.id: (r.dist, r.sid) for r in n.collect()} == brute(points, st)
    plan = n._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


def test_radius(points, stations):
    c = points.select("id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    it = stations.select(F.col("px").alias("ix"), F.col("py").alias("iy"), F.lit(1.5).alias("v"))
    got = {r.id: (r.n_within, r.sum_within) for r in S.radius_totals(c, it, 60.0, "id", "v", crowded=20).collect()}
    want = c.join(it, F.sqrt((F.col("cx") - F.col("ix")) ** 2 + (F.col("cy") - F.col("iy")) ** 2) <= 60.0).groupBy("id").agg(F.count("*").alias("n")).collect()
    n = {r.id: r.n for r in want}
    assert got == {i: (n.get(i, 0), 1.5 * n.get(i, 0)) for i in got} and len(got) == 3000


@pytest.mark.parametrize("rows", [20000, 0])
def test_overlap_mixed_sizes(points, stations, monkeypatch, rows):
    """Broadcast and salted paths give the same pairs, each once."""
    monkeypatch.setattr(S, "BROADCAST_ROWS", rows)
    a = S.polygon_columns(points.filter("id < 600").select("id", G.box_polygon(F.col("x"), F.col("y"), F.col("x") + 3, F.col("y") + 2).alias("parts")))
    k, px, py = F.col("sid"), F.col("px"), F.col("py")
    tri = F.array(G.point(px, py), G.point(px + F.pow(F.lit(2.0), k % 9), py), G.point(px, py + F.pow(F.lit(2.0), k % 7)), G.point(px, py))
    b = S.polygon_columns(stations.filter("sid < 90").select("sid", G.polygon(tri).alias("parts")))
    a, b = materialize(a, "a"), materialize(b, "b")
    got = sorted((r.id, r.r_sid) for r in S.intersecting(a, b, 2.0).select("id", "r_sid").collect())
    b2 = b.select("sid", F.col("edges").alias("e2"), F.col("anchors").alias("a2"))
    want = sorted((r.id, r.sid) for r in a.join(b2, G.polygons_intersect(F.col("edges"), F.col("anchors"), F.col("e2"), F.col("a2"))).select("id", "sid").collect())
    assert got == want and got
    plan = S.intersecting(a, b, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_salted_join(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = J.salted_join(left, right, ["k"], "id", rows_per_task=100)
    assert sorted(map(tuple, got.select("id", "v").collect())) == sorted(map(tuple, left.join(right, "k").select("id", "v").collect()))
    assert J.hot_keys(left, ["k"], 100).count() == 1


L = [(-120.0, 34.9), (-118.0, 34.9), (-118.0, 35.25), (-119.0, 35.25), (-119.0, 35.6), (-120.0, 35.6), (-120.0, 34.9)]


@pytest.fixture(scope="module")
def boundary(spark):
    ring = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in L])
    return S.polygon_columns(spark.range(1).select(G.polygon(ring).alias("parts")))


def test_clip(spark, boundary):
    pts = spark.createDataFrame([("IN", -119.5, 35.0), ("NOTCH", -118.5, 35.4), ("EDGE", -119.0, 35.5)], "id string, x double, y double")
    assert {r.id for r in S.clip_points(pts, boundary, 0.5, "x", "y", "id").collect()} == {"IN", "EDGE"}
    boxes = spark.createDataFrame([("CROSS", -119.5, 35.3, -118.5, 35.5), ("NOTCH", -118.6, 35.3, -118.4, 35.5)], "id string, a double, b double, c double, d double")
    cut = S.clip_polygons(boxes.select("id", G.box_polygon(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("parts")), boundary, 0.5, "id")
    rows = cut.select("id", G.bbox(F.col("parts")).alias("b"), G.area(F.col("parts")).alias("a")).collect()
    assert [(r.id, r.b.xmax) for r in rows] == [("CROSS", -119.0)] and abs(rows[0].a - 0.1) < 1e-9
    line = spark.createDataFrame([(1, [(-119.5, 35.4), (-118.5, 35.4)]), (2, [(-118.5, 35.4), (-118.4, 35.4)])], "id long, line array<struct<x:double,y:double>>")
    out = S.clip_lines(line, boundary, 0.5, "id", "line").collect()
    assert len(out) == 1 and [tuple(p) for p in out[0].pieces[0]] == [(-119.5, 35.4), (-119.0, 35.4)]


def test_measures(spark, boundary):
    r = boundary.select(G.area(F.col("parts")).alias("a"), G.centroid(F.col("parts")).alias("c"), G.geometry_problem(F.col("parts")).alias("p")).first()
    assert abs(r.a - (2 * 0.35 + 1 * 0.35)) < 1e-9 and r.p is None
    assert abs(r.c.x - (0.7 * -119 + 0.35 * -119.5) / 1.05) < 1e-9


def test_projection(spark):
    df = P.add_lonlat(P.add_utm(spark.createDataFrame([(-118.7, 35.3)], "x double, y double"), "x", "y"), "mx", "my")
    r = df.first()
    assert abs(r.mx - 345432.899) < 1e-2 and abs(r.my - 3907638.033) < 1e-2
    assert abs(r.clon + 118.7) < 1e-10 and abs(r.clat - 35.3) < 1e-10


def test_repair(spark):
    bow = F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]])
    r = RP.geometry_repair(spark.range(1).select("id", G.polygon(bow).alias("parts")))
    out = r.select("repair", G.area(F.col("parts")).alias("a"), G.geometry_problem(F.col("parts")).alias("p")).first()
    assert (out.repair, round(out.a, 9), out.p) == ("repaired", 2.0, None)


def plain_hilbert(x, y, bits=16):
    """Rotate-and-reflect walk over the curve."""
    d, n, s = 0, 1 << bits, (1 << bits) >> 1
    while s:
        rx, ry = int((x & s) > 0), int((y & s) > 0)
        d += s * s * ((3 * rx) ^ ry)
        if ry == 0:
            if rx == 1:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s >>= 1
    return d


def test_hilbert(points):
    rows = points.select("x", "y", G.hilbert(F.col("x"), F.col("y"), -1.0, -1.0, 1001.0, 1001.0).alias("h")).limit(300).collect()
    cell = lambda v: min(int((v + 1.0) / 1002.0 * 65536), 65535)
    assert all(r.h == plain_hilbert(cell(r.x), cell(r.y)) for r in rows)


def test_ordered_id(points):
    got = O.ordered_id(points.withColumnRenamed("id", "pid"), ["x", "pid"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 3001))
    assert [(r.x, r.pid) for r in got] == sorted((r.x, r.pid) for r in got)


def test_bbox_reaches_scan(spark, tmp_path, points):
    from landsieve.sources.readers import predicate_into_scan
    from landsieve.sources.writers import write_layer
    write_layer(points.select("id", G.box_polygon(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1).alias("parts")), str(tmp_path / "l"))
    plan = predicate_into_scan(spark.read.parquet(str(tmp_path / "l")), (0, 0, 10, 10)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(bbox" in plan or "LessThanOrEqual(bbox.xmin" in plan
    assert math.isfinite(len(plan)) and "geometry" not in plan.split("ReadSchema")[1]
