"""Closed-form map projections: geographic <-> UTM (Krueger series) and geographic -> Web Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _c, point

# GRS80 ellipsoid (SIRGAS 2000 and, to a tenth of a millimetre, WGS84)
_A, _F = 6378137.0, 1 / 298.257222101
_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger series coefficients to fourth order in the third flattening
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
_K0, _FE = 0.9996, 500000.0
GEOGRAPHIC = (4674, 4326)
_R = 6378137.0


def _zone(srid: int) -> tuple[float, float]:
    """Central meridian and false northing of a supported UTM code."""
    if 31978 <= srid <= 31985:  # SIRGAS 2000 / UTM zones 18S-25S
        return (18 + srid - 31978) * 6 - 183.0, 10_000_000.0
    if 32601 <= srid <= 32660:
        return (srid - 32600) * 6 - 183.0, 0.0
    if 32701 <= srid <= 32760:
        return (srid - 32700) * 6 - 183.0, 10_000_000.0
    raise ValueError(f"unsupported projection {srid}")


def to_utm(lon, lat, srid: int = 31983) -> Column:
    """Easting and northing struct in metres."""
    lon, lat = _c(lon), _c(lat)
    lon0, fn = _zone(srid)
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(_FE + _K0 * _RECT * x, fn + _K0 * _RECT * y)


def from_utm(x, y, srid: int = 31983) -> Column:
    """Longitude and latitude struct in degrees."""
    x, y = _c(x), _c(y)
    lon0, fn = _zone(srid)
    xi, eta = (y - fn) / (_K0 * _RECT), (x - _FE) / (_K0 * _RECT)
    xp, ep = xi, eta
    for j, b in enumerate(_BETA, 1):
        xp = xp - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(ep), F.cos(xp))
    return point(lon0 + F.degrees(lam), F.degrees(phi))


def to_mercator(lon, lat) -> Column:
    lon, lat = _c(lon), _c(lat)
    return point(_R * F.radians(lon), _R * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)))


def from_mercator(x, y) -> Column:
    x, y = _c(x), _c(y)
    return point(F.degrees(x / _R), F.degrees(2 * F.atan(F.exp(y / _R)) - math.pi / 2))


def project(p: Column, source: int, target: int) -> Column:
    """Reproject one point struct."""
    if source == target or (source in GEOGRAPHIC and target in GEOGRAPHIC):
        return p
    if source in GEOGRAPHIC:
        geo = p
    elif source == 3857:
        geo = from_mercator(p["x"], p["y"])
    else:
        geo = from_utm(p["x"], p["y"], source)
    if target in GEOGRAPHIC:
        return geo
    return to_mercator(geo["x"], geo["y"]) if target == 3857 else to_utm(geo["x"], geo["y"], target)


def to_crs(coords, target: int, source: int | None = None, default: int = 4674) -> Column:
    """Reproject a vertex array; a missing source CRS means ``default``."""
    src = default if source is None else source
    return F.transform(_c(coords), lambda p: project(p, src, target))
