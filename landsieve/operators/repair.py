"""Repair of invalid polygons (a small share of rows)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsieve.functions import geometry as G
from landsieve.session import ship_package


def _loops(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """Cut a closed ring at its self-crossings into simple loops."""
    pts = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)
    n = len(pts)
    on_edge: list[list[tuple[float, tuple[float, float]]]] = [[] for _ in range(n)]
    for i in range(n):
        ax, ay = pts[i]
        bx, by = pts[(i + 1) % n]
        for j in range(i + 1, n):
            cx, cy = pts[j]
            dx, dy = pts[(j + 1) % n]
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if den == 0:
                continue
            t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
            u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
            if 0 < t < 1 and 0 < u < 1:
                p = (ax + t * (bx - ax), ay + t * (by - ay))
                on_edge[i].append((t, p))
                on_edge[j].append((u, p))
    walk: list[tuple[float, float]] = []
    for i in range(n):
        walk.append(pts[i])
        walk.extend(p for _, p in sorted(on_edge[i]))
    loops, stack, seen = [], [], {}
    for p in walk + walk[:1]:
        if p in seen:
            start = seen[p]
            loop = stack[start:] + [p]
            for q in stack[start + 1:]:
                seen.pop(q, None)
            del stack[start + 1:]
            if len(loop) >= 4:
                loops.append(loop)
        else:
            seen[p] = len(stack)
            stack.append(p)
    return loops


def _area2(loop) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(loop, loop[1:]))


def _inside(point, loop) -> bool:
    """Even-odd test of a point against a closed loop."""
    x, y = point
    odd = False
    for (ax, ay), (bx, by) in zip(loop, loop[1:]):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            odd = not odd
    return odd


def _simple(ring) -> list:
    """Simple loops with area of one ring."""
    pts = [(p["x"], p["y"]) for p in ring]
    if pts and pts[0] != pts[-1]:
        pts.append(pts[0])
    return [lp for lp in _loops(pts) if _area2(lp) != 0]


def _repair(parts) -> list | None:
    """Valid simple parts of one polygon; None when nothing with area is left.

    Every loop of an outer ring is a part of its own. A loop of a hole goes to
    the part that holds it; one that no part holds cuts nothing out.
    """
    out = []
    for part in parts if parts is not None else []:
        shells, holes = [], []
        for k, ring in enumerate(part["rings"]):
            (holes if k else shells).extend(_simple(ring))
        found = [[shell] for shell in shells]
        for hole in holes:
            middle = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
            for rings in found:
                if _inside(middle, rings[0]):
                    rings.append(hole)
                    break
        out.extend({"rings": [[{"x": x, "y": y} for x, y in lp] for lp in rings]} for rings in found)
    return out or None


def geometry_repair(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Replace invalid polygons by valid ones; add ``repair`` (ok, repaired, quarantined).

    Only the rows that fail the check leave the JVM; they keep their columns
    and travel in Arrow batches. A repaired polygon is checked again, and one
    that still fails is quarantined without geometry.
    """
    checked = df.withColumn("_problem", G.geometry_problem(F.col(parts)))
    fine = checked.filter("_problem is null").drop("_problem").withColumn("repair", F.lit("ok"))
    bad = checked.filter("_problem is not null").drop("_problem")

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(parts)
            fixed = pa.array([_repair(p) for p in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], fixed, *batch.columns[at + 1:]], names=batch.schema.names)

    ship_package(df.sparkSession)
    again = bad.mapInArrow(fix, df.schema).withColumn("_problem", G.geometry_problem(F.col(parts)))
    sound = F.col("_problem").isNull()
    mended = again.withColumns({parts: F.when(sound, F.col(parts)),
                                "repair": F.when(sound, F.lit("repaired")).otherwise(F.lit("quarantined"))}).drop("_problem")
    return fine.unionByName(mended)
