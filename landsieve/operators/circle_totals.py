"""Totals of weighted places within a radius of many centres, found with numpy inside a task.

Places are sorted into strips along x, and by y within a strip. What of a strip lies in the circle for sure comes from
running totals; only places close to the circle's edge are tested one by one, so work grows with the edge, not the area.
"""

from __future__ import annotations

import math

import numpy as np

#: Tests of places that cost about as much as the look-ups in one strip, and centres that are worked on at once.
STRIP_COST, AT_ONCE = 12, 4096
#: Bits of the two whole numbers a value is split into: running totals of these are exact.
HIGH_BITS, LOW_BITS = 60, 40


def _whole(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """High and low whole parts of finite values, and the power of two by which they were scaled."""
    top = float(np.abs(v).max(initial=0.0))
    scale = HIGH_BITS - math.frexp(top)[1] - len(v).bit_length()
    scaled = np.ldexp(v, scale)
    high = np.floor(scaled)
    return high.astype(np.int64), np.ldexp(scaled - high, LOW_BITS).astype(np.int64), scale


def circle_totals(cx: np.ndarray, cy: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, s: np.ndarray, radius: float,
                  crowded: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``n`` and of ``s`` over the places within ``radius`` of each centre; more than ``crowded`` places lie in narrow strips."""
    wide = max(np.ptp(x), radius) * max(np.ptp(y), radius)
    k = 1 if len(x) <= crowded else int(np.clip(radius * math.sqrt(2 * len(x) / wide / STRIP_COST), 1, 256))
    width, eps = radius / k, radius * 1e-6
    left, low, span = x.min(), y.min() - 2 * radius, np.ptp(y) + 4 * radius
    strip = np.floor((x - left) / width)
    order = np.lexsort((y, strip))
    x, y, strip, s = x[order], y[order], strip[order], s[order]
    key = strip * span + (y - low)
    finite = np.isfinite(s)
    high, small, scale = _whole(np.where(finite, s, 0.0))
    parts = np.stack([n[order].astype(np.int64), high, small])
    run = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(parts, axis=1)], axis=1)
    out = np.zeros((3, len(cx)), np.int64)
    for at in range(0, len(cx), AT_ONCE):
        px, py = cx[at:at + AT_ONCE], cy[at:at + AT_ONCE]
        first = np.floor((px - left - radius - eps) / width)
        for o in range(2 * k + 2):
            base = first + o
            x0 = left + base * width
            x1 = x0 + width
            near = np.maximum(np.maximum(x0 - px, px - x1) - eps, 0.0)
            far = np.maximum(np.abs(x0 - px), np.abs(x1 - px)) + eps
            reach = np.where(near <= radius, np.sqrt(np.maximum(radius * radius - near * near, 0.0)) + eps, -1.0)
            sure = np.where(far < radius, np.sqrt(np.maximum(radius * radius - far * far, 0.0)) - eps, -1.0)

            def find(v, side, base=base):
                return np.searchsorted(key, base * span + np.clip(v - low, 0.0, span * (1 - 1e-12)), side)

            begin, end = find(py - reach, "left"), find(py + reach, "right")
            end = np.where(reach < 0, begin, np.maximum(begin, end))
            lo, hi = find(py - sure, "left"), find(py + sure, "right")
            lo, hi = np.where(sure > 0, np.clip(lo, begin, end), end), np.where(sure > 0, np.clip(hi, begin, end), end)
            hi = np.maximum(lo, hi)
            out[:, at:at + AT_ONCE] += run[:, hi] - run[:, lo]
            for a, b in ((begin, lo), (hi, end)):
                size = b - a
                ends = np.cumsum(size)
                if not len(ends) or not ends[-1]:
                    continue
                who = np.repeat(np.arange(len(px)), size)
                item = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(a, size)
                dx, dy = px[who] - x[item], py[who] - y[item]
                hit = np.sqrt(dx * dx + dy * dy) <= radius
                got = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(np.where(hit, parts[:, item], 0), axis=1)], axis=1)
                out[:, at:at + AT_ONCE] += got[:, ends] - got[:, ends - size]
    total = np.ldexp(out[1] + np.ldexp(out[2].astype(float), -LOW_BITS), -scale)
    for i in np.flatnonzero(~finite):
        dx, dy = cx - x[i], cy - y[i]
        total = np.where(np.sqrt(dx * dx + dy * dy) <= radius, total + s[i], total)
    return out[0], total
