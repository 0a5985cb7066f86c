"""Coordinates, polygons and projections as column expressions (1.1, F2, F8, G12)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_of(x: Column, y: Column, x0: float, y0: float, cell: float) -> tuple[Column, Column]:
    """(row, col) of a map point in a north-up grid with its corner at (x0, y0)."""
    return F.floor((y0 - y) / cell).cast("int"), F.floor((x - x0) / cell).cast("int")


def centre_of(row: Column, col: Column, x0: float, y0: float, cell: float) -> tuple[Column, Column]:
    return x0 + (col + 0.5) * cell, y0 - (row + 0.5) * cell


def corner_cell(x: Column, y: Column, x0: float, y0: float, cell: float) -> tuple[Column, Column]:
    """As `cell_of`, but truncated towards 0 (the chip variant)."""
    return ((y0 - y) / cell).cast("int"), ((x - x0) / cell).cast("int")


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Odd-crossing test against a ring of vertices, as one generated expression."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ay == by:
            continue
        spans = (y < ay) != (y < by)
        crossings = crossings + F.when(spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return crossings % 2 == 1


def in_bounds(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])  # F8


_R = 6378137.0


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * _R, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * _R


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / _R), F.degrees(2 * F.atan(F.exp(y / _R)) - math.pi / 2)


#: WGS84 and the transverse Mercator scale.
_F, _K0 = 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_A = _R / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series of third order."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon - (6 * zone - 183))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _K0 * _A * x, (10000000 if south else 0) + _K0 * _A * y


def from_utm(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    xi, eta = (y - (10000000 if south else 0)) / (_K0 * _A), (x - 500000) / (_K0 * _A)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return 6 * zone - 183 + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)
