"""Crowded overlays are settled by cells, with the results of all pairs."""

import random

from pyspark.sql import functions as F

from landsieve.functions import geometry as G
from landsieve.operators import spatial as S


def shapes(spark, n, seed, lo, hi):
    """Boxes, every third one a triangle: id, x0, y0, w, h and the polygon."""
    rnd = random.Random(seed)
    rows = [(k, rnd.uniform(0, 4), rnd.uniform(0, 4), rnd.uniform(lo, hi), rnd.uniform(lo, hi)) for k in range(n)]
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    tri = G.polygon(F.array(G.point(x, y), G.point(x + w, y), G.point(x, y + h), G.point(x, y)))
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, w double, h double")
    return rows, S.polygon_columns(df.withColumn("parts", F.when(F.col("id") % 3 == 0, tri).otherwise(G.box_polygon(x, y, x + w, y + h))))


def holds(r, x, y):
    k, x0, y0, w, h = r
    return x0 < x < x0 + w and y0 < y < y0 + h and (k % 3 != 0 or (x - x0) * h + (y - y0) * w < w * h)


def test_smallest_container_of_crowded_polygons(spark, monkeypatch):
    rnd = random.Random(5)
    pts = [(k, rnd.uniform(-0.2, 4.5), rnd.uniform(-0.2, 4.5)) for k in range(1000)]
    points = spark.createDataFrame(pts, "id long, x double, y double")
    tests, write = [], S.materialize

    def noted(df, name, **more):
        out = write(df, name, **more)
        if name == "cell-tests":
            tests.append(out.count())
        return out

    monkeypatch.setattr(S, "materialize", noted)
    for n in (200, 1600):
        rows, polys = shapes(spark, n, 7, 0.2, 0.7)
        zones = polys.withColumn("area", F.col("w") * F.col("h")).withColumnRenamed("id", "zid")
        got = {r.id: r.container_id for r in S.smallest_container(points, zones, 0.05, "x", "y", "id", "area", "zid", []).collect()}
        want = {k: min(((r[3] * r[4], r[0]) for r in rows if holds(r, x, y)), default=None) for k, x, y in pts}
        assert got == {k: v[1] for k, v in want.items() if v}
    # eight times the polygons, but no more of them are left to be tested in a cell
    assert tests[1] < 2 * tests[0], tests


def test_meeting_joins_only_the_gaps(spark, monkeypatch):
    rnd, joined, pairs = random.Random(3), [], S.intersecting

    def noted(left, *more):
        joined.append(left.count())
        return pairs(left, *more)

    monkeypatch.setattr(S, "intersecting", noted)
    for n in (20, 1000):
        _, right = shapes(spark, n, 9, 0.2, 0.7)
        _, left = shapes(spark, 2000, rnd.random(), 0.02, 0.06)
        got = sorted(r.id for r in S.meeting(left, right, 0.1).collect())
        assert got == sorted(r.id for r in pairs(left, right, 0.1).select("id").distinct().collect())
    assert joined[1] < 0.1 * 2000 < joined[0], joined
