"""Work that grows with the tables: what is dealt to all cores, settled in place, or not read again."""

import pytest
from pyspark.sql import functions as F

from landsieve.functions import geometry as G
from landsieve.operators import ordering as O
from landsieve.operators import raster as R
from landsieve.operators import spatial as S
from landsieve.operators.joins import product_join
from landsieve.plans.build import build_county
from suite.tables import boundary, view
from tests.test_fragments import layer, wavy

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["overlays", "requests", "solar", "substations"])
def test_small_tables_are_dealt_to_all_cores(spark, name):
    """A table in one file is derived by all cores (F18)."""
    assert view(spark, SF, name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_points_are_clipped_in_place(spark):
    """No pairs and no shuffle, and the same points as a test of each, on borders too (F13)."""
    ring = wavy(300, -119.0, 35.2, 0.5, 7)
    for area in (boundary(spark).select("bbox", "edges"), layer(spark, [(1, [ring])])):
        pts = spark.range(81 * 41).select("id", (F.lit(-120.0) + F.col("id") % 81 * 0.025).alias("x"),
                                          (F.lit(34.7) + F.floor(F.col("id") / 81) * 0.025).alias("y"))
        pts = pts.unionByName(spark.createDataFrame([(-1, -119.9, 34.9), (-2, -118.1, 35.0), (-3, None, 35.0)], "id long, x double, y double"))
        got = S.clip_points(pts, area, 0.25, "x", "y", "id")
        # sides of the boundary are cast to rows here, all of them against all points
        want = pts.crossJoin(F.broadcast(area.select(F.col("edges")))).filter(G.covers(F.col("x"), F.col("y"), F.col("edges")))
        assert sorted(r[0] for r in got.select("id").collect()) == sorted(r[0] for r in want.select("id").collect())
        assert "Distinct" not in plan(got) and "Aggregate" not in plan(got)


def test_only_the_county_asked_for_is_parsed(spark):
    """The attributes pick the feature before any geometry is read or repaired (F18)."""
    rows = [({"GEOID": g, "STATEFP": g[:2], "COUNTYFP": g[2:], "NAME": g}, "Polygon", "[[[0,0],[2,0],[2,2],[0,2],[0,0]]]", "f", i)
            for i, g in enumerate(["06029", "06031", "07029"])]
    found = build_county(spark.createDataFrame(rows, "properties map<string,string>, kind string, coordinates string, source_file string, pos int"))
    assert [r["geoid"] for r in found.collect()] == ["06029"]
    assert found.inputFiles() and all("picked-features" in f for f in found.inputFiles())
    assert spark.read.parquet(*found.inputFiles()).count() == 1


def test_ordered_files_are_not_opened_again(spark, tmp_path):
    """What a file covers comes from the rows written, and is what the files hold (F22)."""
    p = spark.range(1000).select("id", G.point_bbox((F.col("id") * 37 % 101).cast("double"), (F.col("id") * 53 % 89).cast("double")).alias("bbox"))
    boxes = O.write_ordered(p, str(tmp_path / "o"), 70)
    assert not any("/o/file=" in f for f in boxes.inputFiles())
    written = O.file_boxes(spark.read.parquet(str(tmp_path / "o")))
    assert sorted(map(tuple, boxes.collect())) == sorted(map(tuple, written.collect()))


def test_matches_of_one_name_are_dealt_out(spark):
    """A key with many rows on both sides comes out of several tasks (F15)."""
    left = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") < 290, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.range(200).select(F.col("id").alias("b"), F.when(F.col("id") < 190, "hot").otherwise((F.col("id") + 100).cast("string")).alias("k"))
    got = product_join(left, right, ["k"], "a", rows_per_task=1000)
    want = left.join(right, "k")
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).isEmpty()
    assert "_salt" in plan(got)


def test_runs_and_sums_leave_the_expressions(spark):
    """Strips, merges and running sums are worked on in Arrow batches; one crowded row is dealt out (F14, F17, F20)."""
    grid = R.Grid(0.0, 0.0, 1.0, 1.0, 10, 300)
    p = layer(spark, [(1, [[[0.5, 0.5], [280.5, 0.5], [280.5, 1.5], [0.5, 1.5], [0.5, 0.5]]]), (2, [wavy(30, 20.0, 5.0, 3.0, 4)])])
    runs = R.covered_runs(p, grid, ["id"])
    assert [tuple(r) for r in runs.filter("id = 1").orderBy("row").collect()] == [(1, 0, 0, 280), (1, 1, 0, 280)]
    assert "MapInArrow" in plan(runs)
    cells = spark.range(3000).select(F.floor(F.col("id") / 300).alias("row"), (F.col("id") % 300).alias("col"),
                                     F.when(F.col("id") % 7 != 3, F.col("id") * 0.5).alias("value"))
    sums = R.row_sums(cells)
    assert "MapInArrow" in plan(sums)
    one = sums.filter("row = 1 and seg = 1").first()
    want = [c for c in range(256, 300) if (300 + c) % 7 != 3]
    assert one["counts"][-1] == len(want) and one["sums"][-1] == sum((300 + c) * 0.5 for c in want) and len(one["sums"]) == 257
    got = {r[0]: r[1] for r in R.zonal_mean(R.assign_runs(p, grid, ["id"], "all"), cells).collect()}
    hit = R.touched_cells(p, grid).join(cells, ["row", "col"]).filter("value is not null").groupBy("id").agg(F.avg("value"))
    assert got == pytest.approx({r[0]: r[1] for r in hit.collect()})
