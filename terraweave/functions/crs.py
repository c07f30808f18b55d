"""Transverse Mercator (UTM on WGS 84) as column arithmetic and as a numpy kernel.

The Krueger series to the fourth order in the third flattening; the error
inside a zone is far below a millimetre.  The column form stays in whole-stage
code generation, so a reprojection never leaves the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the UTM grid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0

_N = FLATTENING / (2.0 - FLATTENING)
_E = float(np.sqrt(FLATTENING * (2.0 - FLATTENING)))
_RADIUS = SCALE * SEMI_MAJOR / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
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


def central_meridian(zone: int) -> float:
    """Longitude in degrees of the middle of a UTM zone."""
    return zone * 6.0 - 183.0


def utm_zone(lon: float) -> int:
    return int((lon + 180.0) // 6.0) + 1


def metric_epsg(lon: float, lat: float) -> int:
    """EPSG code of the UTM zone that covers a position."""
    return (32600 if lat >= 0 else 32700) + utm_zone(lon)


def _northing_arc(m, sin_phi):
    return m.sinh(m.atanh(sin_phi) - m.atanh(sin_phi * _E) * _E)


def _series(m, first, second, a, b, terms, sign: float):
    """first + sign * sum of term * cos(2ja) sinh(2jb), and the sine twin of it."""
    for j, c in enumerate(terms, 1):
        first = first + m.cos(a * (2.0 * j)) * m.sinh(b * (2.0 * j)) * (sign * c)
        second = second + m.sin(a * (2.0 * j)) * m.cosh(b * (2.0 * j)) * (sign * c)
    return first, second


def _latitude(m, chi):
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + m.sin(chi * (2.0 * j)) * d
    return phi


class _NumpyMath:
    sin, cos, sinh, cosh, atanh = np.sin, np.cos, np.sinh, np.cosh, np.arctanh


def add_utm(df: DataFrame, lon: str, lat: str, x: str, y: str, zone: int = 44) -> DataFrame:
    """Add easting and northing of a northern-hemisphere position; null where it is null.

    The steps are separate projections, so that no shared term is evaluated
    twice and the generated code stays small.
    """
    lam, phi = (F.col(lon) - central_meridian(zone)) * (np.pi / 180.0), F.sin(F.col(lat) * (np.pi / 180.0))
    own = df.columns
    df = df.select(*own, F.cos(lam).alias("_cos"), F.sin(lam).alias("_sin"), phi.alias("_phi"))
    df = df.select(*own, "_cos", "_sin", _northing_arc(F, F.col("_phi")).alias("_t"))
    df = df.select(*own, F.atan2("_t", "_cos").alias("_xi"), F.asinh(F.col("_sin") / F.hypot("_t", "_cos")).alias("_eta"))
    east, north = _series(F, F.col("_eta"), F.col("_xi"), F.col("_xi"), F.col("_eta"), _ALPHA, 1.0)
    return df.select(*own, (east * _RADIUS + FALSE_EASTING).alias(x), (north * _RADIUS).alias(y))


def add_lonlat(df: DataFrame, x: str, y: str, lon: str, lat: str, zone: int = 44) -> DataFrame:
    """Add longitude and latitude of a grid position; null where it is null."""
    own = df.columns
    df = df.select(*own, (F.col(y) / _RADIUS).alias("_xi0"), ((F.col(x) - FALSE_EASTING) / _RADIUS).alias("_eta0"))
    eta, xi = _series(F, F.col("_eta0"), F.col("_xi0"), F.col("_xi0"), F.col("_eta0"), _BETA, -1.0)
    df = df.select(*own, eta.alias("_eta"), xi.alias("_xi"))
    df = df.select(*own, "_eta", "_xi", F.asin(F.sin("_xi") / F.cosh("_eta")).alias("_chi"))
    out_lon = F.atan2(F.sinh("_eta"), F.cos("_xi")) * (180.0 / np.pi) + central_meridian(zone)
    return df.select(*own, out_lon.alias(lon), (_latitude(F, F.col("_chi")) * (180.0 / np.pi)).alias(lat))


def to_utm_np(lon, lat, zone: int = 44):
    lam = (np.asarray(lon, float) - central_meridian(zone)) * (np.pi / 180.0)
    t = _northing_arc(_NumpyMath, np.sin(np.asarray(lat, float) * (np.pi / 180.0)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
    east, north = _series(_NumpyMath, eta, xi, xi, eta, _ALPHA, 1.0)
    return east * _RADIUS + FALSE_EASTING, north * _RADIUS


def from_utm_np(x, y, zone: int = 44):
    xi0, eta0 = np.asarray(y, float) / _RADIUS, (np.asarray(x, float) - FALSE_EASTING) / _RADIUS
    eta, xi = _series(_NumpyMath, eta0, xi0, xi0, eta0, _BETA, -1.0)
    lat = _latitude(_NumpyMath, np.arcsin(np.sin(xi) / np.cosh(eta)))
    return np.arctan2(np.sinh(eta), np.cos(xi)) * (180.0 / np.pi) + central_meridian(zone), lat * (180.0 / np.pi)
