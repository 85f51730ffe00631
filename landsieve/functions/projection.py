"""Closed-form map projections as Columns (GRS80; WGS84 and NAD83 taken as equal).

The UTM formulas are the Krueger n-series to fourth order; the Albers inverse
uses the authalic-latitude series. x is always longitude / easting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsieve import constants as K

_A = 6378137.0
_F = 1 / 298.257222101
_N = _F / (2 - _F)
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)

_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_DELTA = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]
UTM_SCALE, UTM_FALSE_EAST, UTM_LON0 = 0.9996, 500000.0, -117.0
_CONF = 2 * math.sqrt(_N) / (1 + _N)


def _utm_sphere(lon: Column, lat: Column) -> list[Column]:
    """Tangent of the conformal latitude, and the longitude from the central meridian."""
    s = F.sin(F.radians(lat))
    return [F.sinh(F.atanh(s) - F.lit(_CONF) * F.atanh(F.lit(_CONF) * s)), F.radians(lon - F.lit(UTM_LON0))]


def _utm_cylinder(t: Column, dl: Column) -> list[Column]:
    return [F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(F.lit(1.0) + t * t))]


def _utm_plane(xi: Column, eta: Column) -> list[Column]:
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + F.lit(a) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
        north = north + F.lit(a) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
    scale = UTM_SCALE * _RADIUS
    return [F.lit(UTM_FALSE_EAST) + F.lit(scale) * east, F.lit(scale) * north]


def _utm_unplane(x: Column, y: Column) -> list[Column]:
    scale = UTM_SCALE * _RADIUS
    return [y / F.lit(scale), (x - F.lit(UTM_FALSE_EAST)) / F.lit(scale)]


def _utm_unroll(xi: Column, eta: Column) -> list[Column]:
    xp, ep = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xp = xp - F.lit(b) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
        ep = ep - F.lit(b) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
    return [xp, ep]


def _utm_unsphere(xp: Column, ep: Column) -> list[Column]:
    return [F.asin(F.sin(xp) / F.cosh(ep)), F.atan2(F.sinh(ep), F.cos(xp))]


def _utm_degrees(chi: Column, dl: Column) -> list[Column]:
    lat = chi
    for j, d in enumerate(_DELTA, start=1):
        lat = lat + F.lit(d) * F.sin(chi * (2.0 * j))
    return [F.lit(UTM_LON0) + F.degrees(dl), F.degrees(lat)]


_FORWARD = [_utm_sphere, _utm_cylinder, _utm_plane]
_INVERSE = [_utm_unplane, _utm_unroll, _utm_unsphere, _utm_degrees]


def _staged(df: DataFrame, steps, x: str, y: str, out_x: str, out_y: str) -> DataFrame:
    """Run the steps as successive projections, so each value is computed once
    inside generated code and no expression grows large."""
    a, b = F.col(x), F.col(y)
    for i, step in enumerate(steps):
        last = i == len(steps) - 1
        na, nb = (out_x, out_y) if last else (f"_p{i}a", f"_p{i}b")
        ca, cb = step(a, b)
        keep = [c for c in df.columns if not c.startswith("_p") and c not in (na, nb)]
        df = df.select(*keep, ca.alias(na), cb.alias(nb))
        a, b = F.col(na), F.col(nb)
    return df


def add_utm(df: DataFrame, lon: str, lat: str, x: str = "mx", y: str = "my") -> DataFrame:
    """Add metric columns of a lon/lat point."""
    return _staged(df, _FORWARD, lon, lat, x, y)


def add_lonlat(df: DataFrame, x: str, y: str, lon: str = "clon", lat: str = "clat") -> DataFrame:
    """Add lon/lat columns of a metric point."""
    return _staged(df, _INVERSE, x, y, lon, lat)


def _bound(steps, a: Column, b: Column) -> Column:
    """The steps as one expression, each pair bound once; struct (x, y)."""
    first, rest = steps[0], steps[1:]
    ca, cb = first(a, b)
    pair = F.struct(ca.alias("x"), cb.alias("y"))
    return pair if not rest else F.transform(F.array(pair), lambda v: _bound(rest, v["x"], v["y"]))[0]


def utm_point(lon: Column, lat: Column) -> Column:
    """Metric point as a struct, for vertices inside arrays."""
    return _bound(_FORWARD, lon, lat)


def lonlat_point(x: Column, y: Column) -> Column:
    return _bound(_INVERSE, x, y)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    p = utm_point(lon, lat)
    return p["x"], p["y"]


def from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    p = lonlat_point(x, y)
    return p["x"], p["y"]


def _q(s):
    """Authalic helper for a plain number."""
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m(phi):
    return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)


_P1, _P2 = math.radians(34.0), math.radians(40.5)
ALBERS_LON0, ALBERS_FALSE_NORTH = -120.0, -4000000.0
ALBERS_N = (_m(_P1) ** 2 - _m(_P2) ** 2) / (_q(math.sin(_P2)) - _q(math.sin(_P1)))
ALBERS_C = _m(_P1) ** 2 + ALBERS_N * _q(math.sin(_P1))
ALBERS_RHO0 = _A * math.sqrt(ALBERS_C - ALBERS_N * _q(0.0)) / ALBERS_N
_QP = _q(1.0)


def to_albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    q = F.lit(1 - _E2) * (
        s / (F.lit(1.0) - F.lit(_E2) * s * s)
        - F.log((F.lit(1.0) - F.lit(_E) * s) / (F.lit(1.0) + F.lit(_E) * s)) / F.lit(2 * _E)
    )
    rho = F.lit(_A) * F.sqrt(F.lit(ALBERS_C) - F.lit(ALBERS_N) * q) / F.lit(ALBERS_N)
    theta = F.lit(ALBERS_N) * F.radians(lon - F.lit(ALBERS_LON0))
    return rho * F.sin(theta), F.lit(ALBERS_FALSE_NORTH + ALBERS_RHO0) - rho * F.cos(theta)


def from_albers(x: Column, y: Column) -> tuple[Column, Column]:
    dy = F.lit(ALBERS_RHO0 + ALBERS_FALSE_NORTH) - y
    rho = F.sqrt(x * x + dy * dy)
    theta = F.atan2(x, dy)
    q = (F.lit(ALBERS_C) - (rho * F.lit(ALBERS_N / _A)) ** 2) / F.lit(ALBERS_N)
    b = F.asin(q / F.lit(_QP))
    e4, e6 = _E2**2, _E2**3
    lat = (
        b
        + F.lit(_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(b * 2.0)
        + F.lit(23 * e4 / 360 + 251 * e6 / 3780) * F.sin(b * 4.0)
        + F.lit(761 * e6 / 45360) * F.sin(b * 6.0)
    )
    # One Newton step takes the truncated series to full precision.
    s = F.sin(lat)
    g = F.lit(1.0) - F.lit(_E2) * s * s
    here = F.lit(1 - _E2) * (
        s / g - F.log((F.lit(1.0) - F.lit(_E) * s) / (F.lit(1.0) + F.lit(_E) * s)) / F.lit(2 * _E))
    lat = lat + (q - here) * g * g / (F.lit(2 * (1 - _E2)) * F.cos(lat))
    return F.lit(ALBERS_LON0) + F.degrees(theta / F.lit(ALBERS_N)), F.degrees(lat)


_GEOGRAPHIC = {K.CRS_STORAGE, K.CRS_SOURCE_NAD83}


def reproject(x: Column, y: Column, from_crs: int, to_crs: int) -> tuple[Column, Column]:
    """Between lon/lat, UTM 11N and California Albers; identity when equal."""
    if from_crs == to_crs or {from_crs, to_crs} <= _GEOGRAPHIC:
        return x, y
    if from_crs == K.CRS_METRIC_UTM:
        x, y = from_utm(x, y)
    elif from_crs == K.CRS_METRIC_ALBERS:
        x, y = from_albers(x, y)
    elif from_crs not in _GEOGRAPHIC:
        raise ValueError(f"unsupported source CRS {from_crs}")
    if to_crs in _GEOGRAPHIC:
        return x, y
    if to_crs == K.CRS_METRIC_UTM:
        return to_utm(x, y)
    if to_crs == K.CRS_METRIC_ALBERS:
        return to_albers(x, y)
    raise ValueError(f"unsupported target CRS {to_crs}")
