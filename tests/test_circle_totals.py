"""Totals within a radius against every pair (F4)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landsieve.operators import circle_totals as CT
from landsieve.operators import spatial as S


@pytest.mark.parametrize("crowded", [0, 10_000])
def test_totals_are_those_of_all_pairs(crowded):
    rng = np.random.default_rng(3)
    for values in (np.arange(3000.0), rng.random(3000) * 10.0 ** rng.integers(-9, 9, 3000) * rng.choice([-1, 1], 3000), np.full(3000, 2.5)):
        x, y, n = rng.integers(0, 400, 3000) / 4.0, rng.integers(0, 400, 3000) / 4.0, rng.integers(1, 4, 3000)
        cx, cy = np.append(rng.integers(-40, 440, 700) / 4.0, x[:50]), np.append(rng.integers(-40, 440, 700) / 4.0, y[:50])
        d = np.sqrt((cx[:, None] - x) ** 2 + (cy[:, None] - y) ** 2) <= 12.5
        count, total = CT.circle_totals(cx, cy, x, y, n, values, 12.5, crowded)
        assert (count == d @ n).all() and np.allclose(total, d @ values, rtol=1e-9, atol=1e-3)


def test_values_without_end_reach_their_own_circles_only():
    x, s = np.array([0.0, 1.0, 50.0]), np.array([1.0, np.inf, 2.0])
    _, total = CT.circle_totals(np.array([0.0, 50.0]), np.zeros(2), x, np.zeros(3), np.ones(3, int), s, 5.0, 0)
    assert total.tolist() == [np.inf, 2.0]


@pytest.mark.parametrize("most", [(1 << 17, 1 << 20), (50, 1 << 20), (50, 100)])
def test_parts_and_odd_places(spark, monkeypatch, most):
    """Blocks in parts give the same; no centre is listed beside the cells or items around it."""
    monkeypatch.setattr(S, "CIRCLE_CENTRES", most[0])
    monkeypatch.setattr(S, "CIRCLE_ITEMS", most[1])
    rows, write = [], S.materialize

    def counted(df, name, *rest, **more):
        back = write(df, name, *rest, **more)
        rows.append(back.count())
        return back

    monkeypatch.setattr(S, "materialize", counted)
    k = F.col("id")
    c = spark.range(900).select(k, F.when(k == 7, None).when(k == 8, float("nan")).when(k == 9, 1e7).otherwise(k * 37 % 101).cast("double").alias("cx"),
                                (k * 53 % 89).cast("double").alias("cy"))
    c = c.unionByName(c.filter("id < 3"))
    it = spark.range(2000).select(F.when(k == 5, None).otherwise(k * 29 % 103).cast("double").alias("ix"), (k * 31 % 97).cast("double").alias("iy"),
                                  F.when(k % 11 != 3, k * 0.5).alias("v"))
    got = sorted((r.id, r.n_within, r.sum_within) for r in S.radius_totals(c, it, 20.0, "id", "v").collect())
    near = F.sqrt((F.col("cx") - F.col("ix")) ** 2 + (F.col("cy") - F.col("iy")) ** 2) <= 20.0
    each = c.distinct().join(it, near, "left").groupBy("id").agg(F.count("iy").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"))
    assert got == sorted((r.id, r.n, r.s) for r in c.join(each, "id").collect())
    assert max(rows) <= 2000
