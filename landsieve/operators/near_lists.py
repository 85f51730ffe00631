"""The few items of a list that can be nearest to each of many points, found with numpy inside a task.

An item is a segment (a point is one without length). Item j can't be nearest to any point of a box if some point q of
another item is nearer than j to all four corners: the places that are nearer to q than to a point of j by a given
margin lie on one side of a branch of a hyperbola, which holds the whole box with its corners. So a list shrinks with
the box, and boxes are halved until what is left is tested pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs that are tested at once, points from which a box is not halved any more, and items from which a list is not shortened.
PAIRS, FEW_POINTS, FEW_ITEMS = 1 << 16, 32, 8


def feet(x: np.ndarray, y: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place of each item (x, y, dx, dy) to each point, a row for each point."""
    ax, ay, dx, dy = items.T
    len2 = dx * dx + dy * dy
    if not len2.any():
        return np.broadcast_to(ax, (len(x), len(ax))), np.broadcast_to(ay, (len(x), len(ax)))
    ahead = ((x[:, None] - ax) * dx + (y[:, None] - ay) * dy) / np.where(len2 > 0, len2, 1.0)
    t = np.clip(ahead, 0.0, 1.0)
    return ax + t * dx, ay + t * dy


def apart(x, y, fx, fy) -> np.ndarray:
    dx, dy = x - fx, y - fy
    return np.sqrt(dx * dx + dy * dy)


def possible(x0: float, y0: float, x1: float, y1: float, items: np.ndarray, margin: float) -> np.ndarray:
    """Which items can be nearest to some point of a box."""
    px = np.array([x0, x0, x1, x1, (x0 + x1) / 2])
    py = np.array([y0, y1, y0, y1, (y0 + y1) / 2])
    fx, fy = feet(px, py, items)
    low = apart(px[:, None], py[:, None], fx, fy)
    best = low.argmin(axis=1)
    each = np.arange(len(px))
    qx, qy = fx[each, best], fy[each, best]
    high = apart(px[:4], py[:4], qx[:, None], qy[:, None])
    return ~(high[:, :, None] + margin < low[None, :4]).all(axis=1).any(axis=0)


def near_items(x: np.ndarray, y: np.ndarray, items: np.ndarray, margin: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of points and, beside them, of the items no more than ``margin`` farther than the nearest, in parts."""
    todo = [(np.arange(len(x)), np.arange(len(items)))]
    while todo:
        points, some = todo.pop()
        px, py = x[points], y[points]
        x0, x1, y0, y1 = px.min(), px.max(), py.min(), py.max()
        if len(some) > FEW_ITEMS:
            some = some[possible(x0, y0, x1, y1, items[some], margin)]
        if len(points) > FEW_POINTS and len(some) > FEW_ITEMS and (x1 > x0 or y1 > y0):
            v = px if x1 - x0 >= y1 - y0 else py
            half = len(points) // 2
            order = np.argpartition(v, half)
            todo += [(points[order[:half]], some), (points[order[half:]], some)]
            continue
        step = max(1, PAIRS // max(1, len(some)))
        for at in range(0, len(points), step):
            own, ox, oy = points[at:at + step], px[at:at + step], py[at:at + step]
            fx, fy = feet(ox, oy, items[some])
            d = apart(ox[:, None], oy[:, None], fx, fy)
            i, j = np.nonzero(d <= d.min(axis=1)[:, None] + margin)
            yield own[i], some[j]
