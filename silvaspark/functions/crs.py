"""Coordinate systems by EPSG number: degrees (4326), web mercator (3857), UTM zones (326zz north, 327zz south).

``transform`` is written once for columns, arrays and numbers: ``m`` is the namespace that the functions come from.
UTM is the transverse Mercator series to the third power of the flattening, good to well under a millimetre in a zone.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996

COLUMNS = F
ARRAYS = SimpleNamespace(radians=np.radians, degrees=np.degrees, sin=np.sin, cos=np.cos, tan=np.tan, sinh=np.sinh, cosh=np.cosh, atan=np.arctan, atanh=np.arctanh, asin=np.arcsin, atan2=np.arctan2, exp=np.exp, log=np.log, sqrt=np.sqrt)
NUMBERS = SimpleNamespace(**{k: getattr(math, k) for k in vars(ARRAYS)})


def zone(srid: int) -> tuple[int, float]:
    """Central meridian in degrees and false northing of a UTM system; others raise ValueError."""
    if srid // 100 not in (326, 327) or not 1 <= srid % 100 <= 60:
        raise ValueError(f"{srid} is none of 4326, 3857 and the UTM zones")
    return (srid % 100) * 6 - 183, 10_000_000.0 if srid // 100 == 327 else 0.0


def _series() -> tuple[float, float, tuple, tuple, tuple]:
    """Third flattening, rectifying radius, and the factors there, back, and from conformal to geographic latitude."""
    n = FLATTENING / (2 - FLATTENING)
    radius = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    latitude = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return n, radius, there, back, latitude


def _to_degrees(x, y, srid: int, m):
    if srid == 4326:
        return x, y
    if srid == 3857:
        return m.degrees(x / RADIUS), m.degrees(2 * m.atan(m.exp(y / RADIUS)) - math.pi / 2)
    meridian, north = zone(srid)
    _, radius, _, back, latitude = _series()
    xi, eta = (y - north) / (SCALE * radius), (x - 500000.0) / (SCALE * radius)
    u, v = xi, eta
    for j, c in enumerate(back, 1):
        u = u - c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        v = v - c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(u) / m.cosh(v))
    phi = chi
    for j, c in enumerate(latitude, 1):
        phi = phi + c * m.sin(2 * j * chi)
    return meridian + m.degrees(m.atan2(m.sinh(v), m.cos(u))), m.degrees(phi)


def _from_degrees(lon, lat, srid: int, m):
    if srid == 4326:
        return lon, lat
    if srid == 3857:
        return m.radians(lon) * RADIUS, m.log(m.tan(math.pi / 4 + m.radians(lat) / 2)) * RADIUS
    meridian, north = zone(srid)
    n, radius, there, _, _ = _series()
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = m.radians(lat), m.radians(lon - meridian)
    t = m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    u, v = xi, eta
    for j, c in enumerate(there, 1):
        u = u + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        v = v + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    return 500000.0 + SCALE * radius * v, north + SCALE * radius * u


def transform(x, y, source: int, target: int, m=COLUMNS):
    """Coordinates of one system in another, by way of degrees."""
    return (x, y) if source == target else _from_degrees(*_to_degrees(x, y, source, m), target, m)
