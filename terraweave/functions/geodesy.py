"""Distances, areas and frames on the ellipsoid, as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and the mean radius of the sphere.
A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
SPHERE = 6371008.8

# Area units in square metres.
UNITS = {
    "m2": 1.0, "hectare": 10000.0, "are": 100.0, "acre": 4046.8564224, "cent": 40.468564224, "sqft": 0.09290304, "ground": 222.967296, "km2": 1e6,
    "kuzhi": 3.34450944, "ankanam": 6.6889, "guntha": 101.17141056, "bigha_assam": 1337.8, "kanal": 505.857, "marla": 25.2929,
}


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * SPHERE * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def to_ecef(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(phi), 2))
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + height) * F.sin(phi)


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height by Bowring's closed form; millimetres on the ground."""
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, p * B)
    ep2 = (A * A - B * B) / (B * B)
    phi = F.atan2(z + ep2 * B * F.pow(F.sin(theta), 3), p - E2 * A * F.pow(F.cos(theta), 3))
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(phi), 2))
    return F.degrees(F.atan2(y, x)), F.degrees(phi), p / F.cos(phi) - n


def _q(phi: Column) -> Column:
    """The authalic function of latitude."""
    e, s = math.sqrt(E2), F.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) + F.atanh(s * e) / e)


def ring_area(ring: Column) -> Column:
    """Area of a lon/lat ring on the ellipsoid, by the authalic latitude; exact for parallels and meridians."""
    steps = F.zip_with(
        F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))),
        F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda a, b: F.radians(b["x"] - a["x"]) * (_q(F.radians(a["y"])) + _q(F.radians(b["y"]))) / 2,
    )
    return F.abs(F.aggregate(steps, F.lit(0.0), lambda s, t: s + t)) * A * A / 2


def convert_area(value: Column, source: str, target: str) -> Column:
    return value * (UNITS[source] / UNITS[target])


def vincenty(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 12) -> Column:
    """Geodesic distance by a fixed number of Vincenty's iterations; haversine near the antipode."""
    u1, u2 = F.atan((1 - FLAT) * F.tan(F.radians(lat1))), F.atan((1 - FLAT) * F.tan(F.radians(lat2)))
    base = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("l"))
    zero = F.lit(0.0)
    start = F.struct(base.alias("b"), base["l"].alias("lam"), zero.alias("ss"), zero.alias("cs"), zero.alias("sig"), zero.alias("ca"), zero.alias("cm"))

    def step(s: Column, _: Column) -> Column:
        b, lam = s["b"], s["lam"]
        ss = F.sqrt(F.pow(b["c2"] * F.sin(lam), 2) + F.pow(b["c1"] * b["s2"] - b["s1"] * b["c2"] * F.cos(lam), 2))
        cs = b["s1"] * b["s2"] + b["c1"] * b["c2"] * F.cos(lam)
        sig = F.atan2(ss, cs)
        sa = F.when(ss == 0, 0.0).otherwise(b["c1"] * b["c2"] * F.sin(lam) / ss)
        ca = 1 - sa * sa
        cm = F.when(ca <= 1e-15, 0.0).otherwise(cs - 2 * b["s1"] * b["s2"] / ca)
        c = FLAT / 16 * ca * (4 + FLAT * (4 - 3 * ca))
        new = b["l"] + (1 - c) * FLAT * sa * (sig + c * ss * (cm + c * cs * (-1 + 2 * cm * cm)))
        return F.struct(b.alias("b"), new.alias("lam"), ss.alias("ss"), cs.alias("cs"), sig.alias("sig"), ca.alias("ca"), cm.alias("cm"))

    def finish(s: Column) -> Column:
        u = s["ca"] * (A * A - B * B) / (B * B)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = small * s["ss"] * (s["cm"] + small / 4 * (s["cs"] * (-1 + 2 * s["cm"] * s["cm"]) - small / 6 * s["cm"] * (-3 + 4 * s["ss"] * s["ss"]) * (-3 + 4 * s["cm"] * s["cm"])))
        return B * big * (s["sig"] - d)

    far = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, finish)
    return F.when(F.abs(lon2 - lon1) > 179.3, haversine(lon1, lat1, lon2, lat2)).otherwise(F.coalesce(F.nanvl(far, haversine(lon1, lat1, lon2, lat2)), F.lit(0.0)))


def extent_text(value: Column, style: str = "acre") -> Column:
    """An area in square metres as records print it: acres and cents, grounds, or square metres alone."""
    metres = F.format_string("%,.2f m²", value)
    acres = value / UNITS["acre"]
    cents = F.bround((acres - F.floor(acres)) * 100).cast("int")
    if style == "acre":
        return F.format_string("%d.%02d acre (%s)", F.floor(acres) + (cents == 100).cast("int"), F.when(cents == 100, 0).otherwise(cents), metres)
    if style == "ground":
        return F.format_string("%.3f ground (%s)", value / UNITS["ground"], metres)
    return metres


def polygon_area(rings: Column) -> Column:
    """Area of a lon/lat polygon on the ellipsoid: its first ring less the others."""
    areas = F.transform(rings, ring_area)
    return F.get(areas, F.lit(0)) * 2 - F.aggregate(areas, F.lit(0.0), lambda s, v: s + v)


def metric_frame(lon: Column, lat: Column) -> Column:
    """The EPSG code in which lengths are measured at a place: the UTM zone of its hemisphere; null off the globe."""
    code = F.floor((lon + 180) / 6) + 1 + F.when(lat >= 0, 32600).otherwise(32700)
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), F.concat(F.lit("EPSG:"), code.cast("string")))
