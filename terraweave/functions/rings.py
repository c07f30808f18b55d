"""Measures of polygon rings with higher-order array functions; a ring is ARRAY<STRUCT<x, y>>, closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(ring: Column) -> Column:
    """Consecutive vertices as STRUCT<x1, y1, x2, y2>."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    return _total(F.transform(segments(ring), lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _total(F.transform(segments(ring), lambda s: F.sqrt(F.pow(s["x2"] - s["x1"], 2) + F.pow(s["y2"] - s["y1"], 2))))


def compactness(ring: Column) -> Column:
    """4 pi A / P squared; null for a ring without length."""
    p = perimeter(ring)
    return F.when(p > 0, 4 * 3.141592653589793 * area(ring) / (p * p))


def centroid(ring: Column) -> tuple[Column, Column]:
    w = lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]
    a6 = signed_area(ring) * 6
    cx = _total(F.transform(segments(ring), lambda s: (s["x1"] + s["x2"]) * w(s)))
    cy = _total(F.transform(segments(ring), lambda s: (s["y1"] + s["y2"]) * w(s)))
    return F.when(a6 != 0, cx / a6), F.when(a6 != 0, cy / a6)


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def duplicate_vertices(ring: Column, tolerance: float = 0.005) -> Column:
    return F.size(F.filter(segments(ring), lambda s: F.sqrt(F.pow(s["x2"] - s["x1"], 2) + F.pow(s["y2"] - s["y1"], 2)) < tolerance))


def spikes(ring: Column, degrees: float = 6.0) -> Column:
    """Vertices at which the ring turns back by an angle below a limit."""
    n = F.size(ring) - 1
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    vertex = lambda k: F.get(ring, F.pmod(k, F.greatest(n, F.lit(1))).cast("int"))

    def sharp(k: Column) -> Column:
        a, b, c = vertex(k - 1), vertex(k), vertex(k + 1)
        ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
        length = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
        return (length > 0) & (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / length))) < F.radians(F.lit(degrees)))

    return F.when(n >= 3, F.size(F.filter(at, sharp))).otherwise(0)


def crosses_itself(ring: Column) -> Column:
    """Whether two segments of a ring cross properly."""
    s = segments(ring)
    side = lambda e, x, y: F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))
    cross = lambda e, f: (side(e, f["x1"], f["y1"]) * side(e, f["x2"], f["y2"]) < 0) & (side(f, e["x1"], e["y1"]) * side(f, e["x2"], e["y2"]) < 0)
    return F.exists(s, lambda e: F.exists(s, lambda f: cross(e, f)))


def rounded(ring: Column, digits: int = 3) -> Column:
    return F.transform(ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def shifted(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def violations(ring: Column, micro: float = 1.0, thin: float = 0.18, small: float = 5.0) -> Column:
    """Names of the rules a ring breaks, in a fixed order."""
    rules = {
        "empty": F.size(ring) < 4, "invalid": crosses_itself(ring), "micro_area": (area(ring) < micro) & (area(ring) > 0), "sliver": (F.coalesce(compactness(ring), F.lit(1.0)) < thin) & (area(ring) < small),
        "duplicate_vertex": duplicate_vertices(ring) > 0, "spike": spikes(ring) > 0, "clockwise": signed_area(ring) < 0,
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))


def flat_parts(parts: Column) -> Column:
    """The rings of several polygons in a row: outer rings counter-clockwise, holes clockwise, so that the parts stay apart."""
    turned = lambda r, outer: F.when((signed_area(r) > 0) != outer, F.reverse(r)).otherwise(r)
    return F.flatten(F.transform(parts, lambda p: F.transform(p, lambda r, k: turned(r, k == 0))))


def parts_of(geom: Column) -> Column:
    """The polygons of a MultiPolygon: a counter-clockwise ring begins a new one."""
    zero = F.expr("cast(array() as array<array<array<struct<x:double,y:double>>>>)")
    last = lambda s: F.get(s, F.size(s) - 1)
    return F.aggregate(geom["rings"], zero, lambda s, r: F.when((signed_area(r) > 0) | (F.size(s) == 0), F.concat(s, F.array(F.array(r)))).otherwise(F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.concat(last(s), F.array(r))))))


# The kinds of geometry by their names in capitals.
KINDS = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}


def wkt(geom: Column) -> Column:
    """Well-known text of a GEOM; null for an unknown kind."""
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, pair), ", "), F.lit(")"))
    rings = lambda rs: F.concat(F.lit("("), F.array_join(F.transform(rs, ring), ", "), F.lit(")"))
    kind = F.upper(geom["kind"])
    plain = F.array_join(F.transform(geom["rings"], ring), ", ")
    body = (
        F.when(kind.isin("POINT", "LINESTRING"), plain)
        .when(kind.isin("POLYGON", "MULTILINESTRING", "MULTIPOINT"), F.concat(F.lit("("), plain, F.lit(")")))
        .when(kind == "MULTIPOLYGON", F.concat(F.lit("("), F.array_join(F.transform(parts_of(geom), rings), ", "), F.lit(")")))
    )
    return F.when(F.size(geom["rings"]) > 0, F.concat(kind, F.lit(" "), body))


def from_wkt(text: Column) -> Column:
    """GEOM of a (multi-) point, line or polygon text; all parts are kept, flattened as by ``flat_parts``; null where it is none."""
    kind = F.upper(F.regexp_extract(text, r"(?i)^\s*((?:MULTI)?(?:POINT|LINESTRING|POLYGON))\b", 1))
    shown = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), kind)
    point = lambda t: F.struct(F.split_part(F.trim(t), F.lit(" "), F.lit(1)).try_cast("double").alias("x"), F.get(F.split(F.trim(t), r"\s+"), F.lit(1)).try_cast("double").alias("y"))
    rings = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda r: F.transform(F.split(r, ","), point))
    several = F.split(text, r"\)\s*\)\s*,\s*\(\s*\(")
    parts = F.transform(several, lambda p, k: rings(F.concat(F.when(k > 0, "((").otherwise(""), p, F.when(k < F.size(several) - 1, "))").otherwise(""))))
    # A MULTIPOINT may leave out the brackets of its points.
    loose = F.transform(F.flatten(rings(text)), lambda p: F.array(p))
    found = F.when(kind == "MULTIPOLYGON", flat_parts(parts)).when(kind == "MULTIPOINT", loose).otherwise(rings(text))
    return F.when(shown.isNotNull() & (F.size(found) > 0), F.struct(shown.alias("kind"), found.alias("rings")))
