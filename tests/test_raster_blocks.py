"""Rasters in blocks against cell by cell work."""

import math
import random

import pytest

from landsieve.operators import raster as R


def cells(spark, rows, cols, seed=1, missing=0.05):
    rng = random.Random(seed)
    z = {(r, c): rng.uniform(0, 100) for r in range(rows) for c in range(cols)}
    for k in list(z):
        if rng.random() < missing:
            z[k] = None
    df = spark.createDataFrame([(*k, v) for k, v in z.items()], "row int, col long, z double").repartition(3)
    return df, {k: v for k, v in z.items() if v is not None}


def by_hand(z, rows, cols, dx, dy):
    def diff(k, step, n, at, move):
        low, high = z.get((k[0] - move[0], k[1] - move[1])), z.get((k[0] + move[0], k[1] + move[1]))
        if at == 0:
            return None if high is None else (high - z[k]) / step
        if at == n - 1:
            return None if low is None else (z[k] - low) / step
        return None if low is None or high is None else (high - low) / (2 * step)

    return {k: (diff(k, dx, cols, k[1], (0, 1)), diff(k, dy, rows, k[0], (1, 0))) for k in z}


@pytest.mark.parametrize("size", [4, 7, 256])
def test_gradient_equals_cells(spark, size):
    df, z = cells(spark, 23, 30)
    got = R.slope_gradient(df, 23, 30, 3.0, 2.0, size)
    assert [f.dataType.simpleString() for f in got.schema.fields][:2] == ["int", "bigint"]
    found = {(r["row"], r["col"]): (r["dzdx"], r["dzdy"]) for r in got.collect()}
    want = by_hand(z, 23, 30, 3.0, 2.0)
    assert set(found) == set(want)
    for k, pair in want.items():
        for a, b in zip(found[k], pair, strict=True):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-12))


def test_only_borders_move_twice(spark):
    """Rows shuffled over the cells there are: twice the perimeter over the area of a block, at most."""
    df, _ = cells(spark, 128, 128, missing=0)
    moved = R.in_blocks(df, 32, 1, 1).count()
    assert 128 * 128 < moved <= 128 * 128 * (1 + 2 * 4 * 32 / 32**2)
    plan = R.slope_gradient(df, 128, 128, 1.0, 1.0, 32)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(brow") == 1 and "Join" not in plan


@pytest.mark.parametrize("scale", [0.4, 1.0, 2.5])
def test_resampling_equals_cells(spark, monkeypatch, scale):
    """Finer, equal and coarser targets, shifted so that they also reach past the source."""
    monkeypatch.setattr(R, "BLOCK", 8)
    df, z = cells(spark, 20, 25, 2)
    source = R.Grid(10.0, -5.0, 2.0, 2.0, 20, 25)
    target = R.Grid(9.0, -6.5, 2.0 * scale, 2.0 * scale, int(22 / scale), int(27 / scale))
    found = {(r["row"], r["col"]): r["z"] for r in R.raster_resample(df, source, target).collect()}
    want = {}
    for r in range(target.rows):
        for c in range(target.cols):
            fc = (target.x0 + (c + 0.5) * target.dx - source.x0) / source.dx - 0.5
            fr = (target.y0 + (r + 0.5) * target.dy - source.y0) / source.dy - 0.5
            if not (-0.5 <= fc <= source.cols - 0.5 and -0.5 <= fr <= source.rows - 0.5):
                continue
            total = weight = 0.0
            for i in (0, 1):
                for j in (0, 1):
                    w = abs(1 - i - (fr - math.floor(fr))) * abs(1 - j - (fc - math.floor(fc)))
                    v = z.get((math.floor(fr) + i, math.floor(fc) + j))
                    if v is not None and w > 0:
                        total, weight = total + w * v, weight + w
            if weight:
                want[r, c] = total / weight
    assert set(found) == set(want) and all(math.isclose(found[k], want[k], rel_tol=1e-9) for k in want)


def test_empty_and_missing_rasters(spark):
    none = spark.createDataFrame([], "row long, col long, z double")
    holes = spark.createDataFrame([(0, 0, None), (0, 1, float("nan"))], "row long, col long, z double")
    grid = R.Grid(0.0, 0.0, 1.0, 1.0, 1, 2)
    for df in (none, holes):
        assert R.slope_gradient(df, 1, 2, 1.0, 1.0).collect() == [] and R.raster_resample(df, grid, grid).collect() == []
