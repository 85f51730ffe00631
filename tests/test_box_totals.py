"""Totals over the polygons that meet, counted instead of listed (F12)."""

import numpy as np
from pyspark.sql import functions as F

from landsieve.operators import box_totals as BT
from landsieve.operators import spatial as S
from tests.test_fragments import layer


def box(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def boxes(rng, n, first):
    at, size = rng.integers(0, 40, (n, 2)), rng.integers(1, 6, (n, 2))
    return [(first + k, [box(*map(float, (*at[k], *(at[k] + size[k]))))]) for k in range(n)]


def test_points_before_a_point_match_brute_force():
    rng = np.random.default_rng(1)
    for m, n in ((0, 5), (1, 5), (64, 80), (100, 300)):
        px, py, qx, qy = (rng.integers(0, 12, k).astype(float) for k in (m, m, n, n))
        v = rng.integers(-9, 9, m)
        for x_equal in (True, False):
            for y_equal in (True, False):
                hit = ((px <= qx[:, None]) if x_equal else (px < qx[:, None])) & ((py <= qy[:, None]) if y_equal else (py < qy[:, None]))
                got = BT.dominated(px, py, v, qx, qy, x_equal, y_equal)
                assert (got[0] == hit.sum(1)).all() and (got[1] == hit @ v).all()


def test_totals_match_the_listed_pairs(spark, monkeypatch):
    """Borders that touch count, several strips meet, and triangles are joined pair by pair; boxes are in no pair."""
    monkeypatch.setattr(BT, "STRIP_ROWS", 20)
    rng = np.random.default_rng(2)
    left, right = boxes(rng, 120, 1), boxes(rng, 90, 1000)
    tri = [(500, [[[3.0, 3.0], [9.0, 3.0], [3.0, 9.0], [3.0, 3.0]]])]
    far = [(501, [box(100.0, 100.0, 101.0, 101.0)])]
    a, b = layer(spark, left + tri + far), layer(spark, right + [(2000, tri[0][1])])
    want = S.intersecting(a, b, 5.0, right_id="id").groupBy("id").agg(F.count("*").alias("n"), F.sum("r_id").alias("total"))
    got = BT.meeting_totals(a, b, 5.0, "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    seen = []
    monkeypatch.setattr(BT, "intersecting", lambda *args, **kw: seen.append(args) or S.intersecting(*args, **kw))
    BT.meeting_totals(layer(spark, left), layer(spark, right), 5.0, "id").count()
    assert not seen


def test_only_whole_boxes_are_boxes(spark):
    spike = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [1.0, 0.0], [0.0, 0.0]]
    rows = layer(spark, [(1, [box(0.0, 0.0, 1.0, 2.0)]), (2, [spike]), (3, [box(0.0, 0.0, 4.0, 4.0), box(1.0, 1.0, 2.0, 2.0)])])
    assert [r[0] for r in rows.filter(BT.is_box()).select("id").collect()] == [1]
