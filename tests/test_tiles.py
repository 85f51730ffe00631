"""Thinning of tiles by density."""

import random

import pytest
from pyspark.sql import functions as F

from landsieve.operators import tiles as T


def points(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, *((rng.gauss(-118.9, 0.01), rng.gauss(35.3, 0.01)) if i % 3 else (rng.uniform(-119.5, -118), rng.uniform(34.9, 35.7)))) for i in range(n)]
    rows += [(n + i, -118.77, 35.11) for i in range(20)]  # twenty at one place
    return spark.createDataFrame(rows, "id long, x double, y double").select("id", F.lit("a").alias("apn"), F.lit(1.0).alias("acres"), "x", "y").repartition(5)


def kept(spark, p, limit, zooms):
    out = {}
    for r in T.tile_thin(p, "x", "y", limit, zooms).collect():
        out.setdefault((r["zoom"], r["tile_x"], r["tile_y"]), []).append((r["gap"], r["id"]))
    return out


@pytest.mark.parametrize("limit", [3, 40])
def test_equals_gaps_by_hand(spark, limit):
    p = points(spark, 600, 1)
    where = p.withColumn("m", T.curve_position(F.col("x"), F.col("y"))).select("id", "m").collect()
    got = kept(spark, p, limit, range(7, 13))
    for zoom in range(7, 13):
        tiles = {}
        for r in sorted(where, key=lambda r: (r["m"], r["id"])):
            tiles.setdefault(r["m"] >> 2 * (T.CURVE_BITS - zoom), []).append((r["m"], r["id"]))
        want = []
        for items in tiles.values():
            gaps = [(T.APART if k == 0 else m - items[k - 1][0], i) for k, (m, i) in enumerate(items)]
            want.append(sorted(sorted(gaps, key=lambda g: (-g[0], g[1]))[:limit]))
        assert sorted(want) == sorted(sorted(v) for (z, _, _), v in got.items() if z == zoom)


def test_the_densest_points_go_first(spark):
    """The fewer points fit, the wider the least gap kept, and a crowd is thinned before what is scattered."""
    p, least = points(spark, 1600, 2), []
    for limit in (800, 200, 50, 5):
        (tile,) = kept(spark, p, limit, range(1, 2)).values()
        least.append(min(g for g, _ in tile))
        assert len(tile) == limit
    assert least == sorted(least)
    rest = kept(spark, p, 50, range(1, 2)).popitem()[1]
    assert sum(1 for _, i in rest if i < 1600 and i % 3 == 0) > 40  # a third of all points, nearly all of those kept


def test_a_tile_that_fits_keeps_everything(spark):
    p = points(spark, 30, 3)
    assert sum(len(v) for v in kept(spark, p, 1000, range(8, 9)).values()) == 50
    none = p.withColumn("x", F.lit(None).cast("double"))
    assert kept(spark, none, 5, range(8, 9)) == {} and kept(spark, p.filter("id < 0"), 5, range(8, 9)) == {}
