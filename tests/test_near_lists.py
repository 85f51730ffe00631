"""Nearest lines and points where the items lie in a narrow band far from most points (F1, F5)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landsieve.functions import geometry as G
from landsieve.operators import near_lists as NL
from landsieve.operators import spatial as S
from landsieve.session import materialize


@pytest.fixture(scope="module")
def band(spark):
    """Points all over a square of 100 km, and lines of some kilometres close to its diagonal."""
    pts = materialize(spark.range(4000).select("id", (F.col("id") * 7919 % 4001 * 25.0).alias("x"), (F.col("id") * 104729 % 3989 * 25.0).alias("y")), "pts")
    x, y = F.col("id") * 7907 % 4003 * 25.0, F.col("id") * 7901 % 3989 * 25.0
    lines = spark.range(1500).select((F.col("id") % 1400).alias("line_id"), F.array(
        G.point(x, y), G.point(x + 2000.0 + F.col("id") % 10 * 90.0, y + 1000.0), G.point(x + 3000.0, y - 1500.0)).alias("line"))
    return pts, materialize(lines, "lines")


def test_lines_of_a_band(spark, band, monkeypatch):
    """Least distance and id as found by brute force, and far fewer items handed out than the lists held before (131 019)."""
    pts, lines = band
    handed, weigh = [], S._near_lists

    def counted(probe, items, keys, *rest):
        handed.append(items.count())
        return weigh(probe, items, keys, *rest)

    monkeypatch.setattr(S, "_near_lists", counted)
    got = {r.id: (r.dist, r.line_id) for r in S.nearest_line(pts, lines, "id", "x", "y", "line_id", "line").collect()}
    seg = lines.select("line_id", F.explode(G.ring_edges(F.col("line"))).alias("e"))
    p, s = pts.orderBy("id").collect(), seg.select("line_id", "e.*").collect()
    at = np.array([(r.x1, r.y1, r.x2 - r.x1, r.y2 - r.y1) for r in s])
    x, y, ids = np.array([r.x for r in p]), np.array([r.y for r in p]), np.array([r.line_id for r in s])
    d = NL.apart(x[:, None], y[:, None], *NL.feet(x, y, at))
    least = d.min(axis=1)
    assert len(got) == 4000 and max(abs(got[r.id][0] - v) for r, v in zip(p, least, strict=True)) < 1e-6
    near = d <= least[:, None] + 1e-7
    assert all(got[r.id][1] in ids[n] for r, n in zip(p, near, strict=True))
    assert len(handed) == 1 and handed[0] < 131_019 // 4


def test_lists_lose_no_item():
    """Every item within the margin of the nearest is kept, in clusters, at equal places and without extent."""
    rng = np.random.default_rng(5)
    for kind in range(4):
        x, y = rng.random(900) * 100, rng.random(900) * 100
        items = np.stack([*(rng.random((2, 400)) * (1 if kind % 2 else 100) + 200 * (kind == 3)), *((rng.random((2, 400)) - 0.5) * 4 * (kind < 2))], axis=1)
        items[50:60] = items[50]
        x[:40], y[:40] = x[0], y[0]
        margin = [0.0, 1e-9, 0.5, 0.01][kind]
        d = NL.apart(x[:, None], y[:, None], *NL.feet(x, y, items))
        want = set(zip(*map(list, np.nonzero(d <= d.min(axis=1)[:, None] + margin)), strict=True))
        got = [set(zip(i.tolist(), j.tolist(), strict=True)) for i, j in NL.near_items(x, y, items, margin + 1e-12)]
        assert sum(map(len, got)) == len(set().union(*got)) and want <= set().union(*got)
        assert max(d[i, j] - d[i].min() for i, j in set().union(*got)) <= margin + 2e-12


def test_equal_segments_are_one_item(spark):
    lines = spark.createDataFrame([(k, [(0.0, 0.0), (10.0, 0.0)]) for k in (3, 1, 2)], "id long, line array<struct<x:double,y:double>>")
    assert [r.id for r in S.line_pieces(lines, "id", "line", 100.0).collect()] == [1]
