"""Runs of covered cells and means from running sums, against cell by cell tests."""

import random

import pytest
from pyspark.sql import functions as F

from landsieve.functions import geometry as G
from landsieve.operators import raster as R
from tests.test_fragments import box, layer, wavy

GRID = R.Grid(-3.0, -2.0, 0.5, 0.4, 18, 14)


def shapes():
    rng = random.Random(5)
    few = [(i, [box(rng.uniform(-4, 4), rng.uniform(-3, 6), rng.choice([0.05, 0.7, 3.0]), rng.choice([0.1, 2.0]))]) for i in range(20)]
    return few + [(30, [[[-2.2, -1.1], [3.1, 0.3], [-1.7, 4.9], [-2.2, -1.1]]]), (31, [wavy(40, 0, 1, 1.5, 5)]), (32, [wavy(60, 0.5, 1, 2.1, 3), wavy(50, 0.5, 1, 1.2, 4)[::-1]]),
                  (33, [box(-9, -9, 1)]), (34, [box(-9, -9, 30)]), (35, [box(-3.0, -2.0, 0.5, 0.4)])]


def by_cells(spark):
    """(id, row, col) by a test of every cell against every polygon."""
    cell = G.box_polygon(*(F.lit(o) + c * F.lit(s) for c, o, s in (
        (F.col("col"), GRID.x0, GRID.dx), (F.col("row"), GRID.y0, GRID.dy), (F.col("col") + 1, GRID.x0, GRID.dx), (F.col("row") + 1, GRID.y0, GRID.dy))))
    every = spark.range(GRID.rows).withColumnRenamed("id", "row").crossJoin(spark.range(GRID.cols).withColumnRenamed("id", "col"))
    hit = G.polygons_intersect(F.col("edges"), F.col("anchors"), G.edges(cell), G.anchors(cell))
    return {(r["id"], r["row"], r["col"]) for r in layer(spark, shapes()).crossJoin(every).filter(hit).select("id", "row", "col").collect()}


@pytest.fixture(scope="module")
def touched(spark):
    return by_cells(spark)


@pytest.mark.parametrize("large", [3, 48, 1000])
def test_runs_cover_the_touched_cells(spark, touched, large):
    """Whether edges are searched for each strip or dealt to the strips, runs are apart and hold the same cells."""
    rows = R.covered_runs(layer(spark, shapes()), GRID, ["id"], large).collect()
    found = [(r["id"], r["row"], c) for r in rows for c in range(r["c0"], r["c1"] + 1)]
    assert len(found) == len(set(found)) and set(found) == touched


@pytest.mark.parametrize("segment", [4, 256])
def test_assignment_and_means(spark, touched, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)
    rng = random.Random(1)
    z = {(r, c): rng.choice([None, float("nan"), float("inf"), *[float(k) for k in range(20)]]) for r in range(GRID.rows) for c in range(GRID.cols)}
    cells = spark.createDataFrame([(*k, v) for k, v in z.items()], "row long, col long, value double")
    good = {k: v for k, v in z.items() if v is not None and v == v and v != float("inf")}
    p = layer(spark, shapes())
    last = {}
    for i, r, c in sorted(touched):
        last[r, c] = i
    for mode, own in (("all", touched), ("last", {(i, *k) for k, i in last.items()})):
        assert {tuple(r) for r in R.raster_assign(p, GRID, ["id"], mode).collect()} == own
        want = {}
        for i, r, c in own:
            if (r, c) in good:
                want.setdefault(i, []).append(good[r, c])
        got = {r["id"]: r["m"] for r in R.zonal_mean(R.assign_runs(p, GRID, ["id"], mode), cells, "m").collect()}
        assert got == pytest.approx({i: sum(v) / len(v) for i, v in want.items()})
        by_cell = R.zonal_mean(R.raster_assign(p, GRID, ["id"], mode), cells, "m").collect()
        assert got == pytest.approx({r["id"]: r["m"] for r in by_cell})


def test_rows_grow_with_height_not_area(spark):
    """A parcel ten times as wide has as many runs; copies of a parcel leave one run each in a segment."""
    fine = R.Grid(0.0, 0.0, 1.0, 1.0, 100, 5000)
    for width in (200, 2000):
        p = layer(spark, [(1, [box(0.5, 0.5, width, 50)])])
        assert R.covered_runs(p, fine, ["id"]).count() == 51
    copies = layer(spark, [(i, [box(0.5, 0.5, 300, 9)]) for i in range(200)])
    runs = R.assign_runs(copies, fine, ["id"]).collect()
    assert {r["id"] for r in runs} == {199} and len(runs) == 10 * 2
