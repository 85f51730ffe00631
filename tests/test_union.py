"""Unions of overlapping polygons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from landsieve.operators.union import boundary_union
from tests.test_fragments import box, layer, wavy


def areas(spark, rows, cell, codes=None):
    p = layer(spark, rows).withColumn("code", F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("id") + 1).cast("int")) if codes else F.lit("a"))
    return {r["code"]: r["a"] for r in boundary_union(p, "code", cell).groupBy("code").agg(F.sum("area").alias("a")).collect()}


def test_known_overlaps(spark):
    """Nested, shared borders, equal polygons, a hole that another polygon fills in part, slanted crossings."""
    assert areas(spark, [(0, [box(0, 0, 4)]), (1, [box(1, 1, 1)])], 1.5)["a"] == pytest.approx(16)
    assert areas(spark, [(0, [box(0, 0, 2)]), (1, [box(2, 0, 2)]), (2, [box(0, 0, 2)])], 0.7)["a"] == pytest.approx(8)
    assert areas(spark, [(0, [box(0, 0, 4), box(1, 1, 2)[::-1]]), (1, [box(1, 1, 1)])], 3.0)["a"] == pytest.approx(13)
    diamond = [[2.0, -1.0], [5.0, 2.0], [2.0, 5.0], [-1.0, 2.0], [2.0, -1.0]]
    # a square and a diamond: the diamond's four tips stand out, each a triangle of height 1
    for cell in (0.9, 2.0, 50.0):
        assert areas(spark, [(0, [box(0, 0, 4)]), (1, [diamond])], cell)["a"] == pytest.approx(16 + 4 * 1)


def test_groups_are_apart(spark):
    got = areas(spark, [(0, [box(0, 0, 2)]), (1, [box(1, 0, 2)]), (2, [box(1, 0, 2)])], 1.0, ["a", "b", "a"])
    assert got == {"a": pytest.approx(6), "b": pytest.approx(4)}


def test_wavy_polygons_by_sampling(spark):
    """The area equals the share of sampled points that any polygon holds, and doesn't depend on the cells."""
    rng = random.Random(3)
    shapes = [(rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.3, 1.0), rng.choice([3, 5, 8])) for _ in range(7)]
    rows = [(i, [wavy(80, x, y, r, w)]) for i, (x, y, r, w) in enumerate(shapes)]
    found = [areas(spark, rows, cell)["a"] for cell in (0.31, 1.3)]
    assert found[0] == pytest.approx(found[1], rel=1e-9)

    def holds(ring, x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    n, hits = 20_000, 0
    for _ in range(n):
        x, y = rng.uniform(-2.5, 2.5), rng.uniform(-2.5, 2.5)
        hits += any(math.hypot(x - cx, y - cy) < 1.31 * r and holds(ring[0], x, y) for (_, ring), (cx, cy, r, _w) in zip(rows, shapes, strict=True))
    assert found[0] == pytest.approx(25 * hits / n, rel=0.04)


def test_parts_don_t_overlap_and_empty_layers(spark):
    p = layer(spark, [(0, [box(0, 0, 2)]), (1, [box(1, 1, 2)])]).withColumn("code", F.lit("a"))
    rings = [[(v["x"], v["y"]) for v in r["ring"]] for r in boundary_union(p, "code", 10.0).collect()]
    for x, y in ((0.5, 0.5), (1.5, 1.5), (2.5, 2.5), (0.5, 2.5)):
        inside = sum(min(a for a, _ in r) < x < max(a for a, _ in r) and min(b for _, b in r) < y < max(b for _, b in r) for r in rings)
        assert inside == (0 if (x, y) == (0.5, 2.5) else 1)
    assert boundary_union(p.filter("id > 9"), "code", 1.0).collect() == []
