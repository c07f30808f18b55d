"""Joins and measures of polygons with holes and parts: overlays, shapes, snapping and repair.

Candidates come from the box join of the envelopes; what the polygons share is
computed in Arrow batches by ``functions.polygons``.  Geometries are GEOM
columns in a metric frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.functions import polygons as P
from terraweave.functions import rings as R
from terraweave.functions.ground import first_rows
from terraweave.operators.grid import box_join

GEOM = "struct<kind:string,rings:array<array<struct<x:double,y:double>>>>"
#: Where coordinates of the metric frame lie.
EAST, NORTH = (4e5, 8e5), (1.1e6, 1.5e6)


def envelope(geom: Column) -> Column:
    """STRUCT<x1, y1, x2, y2> of all points of a geometry; nulls for an empty one."""
    return R.bounds(F.flatten(geom["rings"]))


def polygon_area(geom: Column) -> Column:
    """Area of the first ring less the others, or of all parts of a MultiPolygon, from coordinates relative to the first vertex."""
    first = F.get(F.get(geom["rings"], F.lit(0)), F.lit(0))
    areas = F.transform(geom["rings"], lambda r: R.signed_area(R.shifted(r, -first["x"], -first["y"])))
    total = lambda f: F.aggregate(F.transform(areas, f), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.lower(geom["kind"]) == "multipolygon", F.abs(total(lambda a: a))).otherwise(F.abs(F.get(areas, F.lit(0))) * 2 - total(F.abs))


def ground_polygons(features: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """(fid, dataset_id, feature_class, properties, geom, x1, y1, x2, y2) of the features whose metric geometry is a polygon on the ground.

    Each feature stands under its smallest id.  Polygons with a ring of fewer
    than four points or any point outside the metric frame are left out.
    """
    rows = features if classes is None else features.where(F.col("feature_class").isin(classes))
    once = first_rows(rows, ["dataset_id", "source_feature_id"], "id", ["feature_class", "properties", "geom_metric"])
    shaped = once.where(F.lower("geom_metric.kind").isin("polygon", "multipolygon")).withColumn("_b", envelope(F.col("geom_metric")))
    fine = (F.col("_b.x1") >= EAST[0]) & (F.col("_b.x2") <= EAST[1]) & (F.col("_b.y1") >= NORTH[0]) & (F.col("_b.y2") <= NORTH[1]) & F.forall("geom_metric.rings", lambda r: F.size(r) >= 4)
    return shaped.where(fine).select(F.col("id").alias("fid"), "dataset_id", "feature_class", "properties", F.col("geom_metric").alias("geom"), "_b.*")


def _added(df: DataFrame, columns: str, function) -> DataFrame:
    """``df`` with the columns that ``function`` makes of each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = function(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[c.strip().split(" ")[0] for c in columns.split(";")]])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join([*fields, *columns.split(";")]))


def with_overlay(pairs: DataFrame, left: str = "l_geom", right: str = "r_geom") -> DataFrame:
    """Add area_l, area_r and shared, the areas of both polygons and of what they have in common; 0 for null and empty ones."""

    def areas(batch: pa.RecordBatch) -> list[pa.Array]:
        edges = [P.edges_of(batch.column(c)) for c in (left, right)]
        return [pa.array(a) for a in P.overlay_areas(*edges, batch.num_rows)]

    return _added(pairs, "area_l double;area_r double;shared double", areas)


def overlay_join(left: DataFrame, right: DataFrame, least: float = 0.0, cell: float = 32.0, scales: tuple[int, ...] = (1, 16)) -> DataFrame:
    """Pairs of polygons that share more than ``least`` square metres, with area_l, area_r and shared.

    ``left`` and ``right`` have fid, geom and the envelope x1, y1, x2, y2; their
    columns come with the prefixes l_ and r_.  Polygons that only touch share
    nothing; equal ones are all paired; empty sides give no rows.
    """
    return with_overlay(box_join(left, right, 0.0, cell, scales)).where((F.col("shared") > least) & (F.col("shared") > 0))


def iou() -> Column:
    return F.col("shared") / (F.col("area_l") + F.col("area_r") - F.col("shared"))


def containment() -> Column:
    return F.col("shared") / F.least("area_l", "area_r")


def largest_share(left: DataFrame, right: DataFrame, share: float = 0.25, least: float = 0.0) -> DataFrame:
    """Each left polygon with the right one that covers most of it, if at least ``share`` of its area and ``least`` square metres; left outer.

    Adds parent, covered and own_area; of equals the smaller id counts.
    """
    pairs = overlay_join(left.select("fid", "geom", "x1", "y1", "x2", "y2"), right.select("fid", "geom", "x1", "y1", "x2", "y2"))
    good = pairs.where((F.col("shared") >= F.col("area_l") * share) & (F.col("shared") >= least))
    best = good.groupBy(F.col("l_fid").alias("fid")).agg(F.min_by(F.struct("r_fid", "shared"), F.struct(-F.col("shared"), "r_fid")).alias("b"))
    return left.join(best, "fid", "left").select(*left.columns, F.col("b.r_fid").alias("parent"), F.coalesce("b.shared", F.lit(0.0)).alias("covered"), polygon_area(F.col("geom")).alias("own_area"))


def _outer_rings(column: pa.Array) -> list[np.ndarray | None]:
    owner, ring, x, y = P.ring_points(column)
    out: list[np.ndarray | None] = [None] * len(column)
    if len(owner):
        begin = np.flatnonzero(np.append(True, ring[1:] != ring[:-1]))
        for a, b in zip(begin, np.append(begin[1:], len(ring))):
            if out[owner[a]] is None and b - a >= 3:
                points = P.closed_ring(np.column_stack([x[a:b], y[a:b]]))
                out[owner[a]] = points if np.isfinite(points).all() else None
    return out


def with_shapes(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Add what describes the outer ring: hull_area, long_side, short_side, direction (0..180), rectilinear, main (0..90), crossings; null without one."""

    def shapes(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for ring in _outer_rings(batch.column(geom)):
            if ring is None:
                rows.append([None] * 7)
                continue
            long_, short, angle = P.least_rectangle(ring)
            share, main = P.rectilinearity(ring)
            rows.append([abs(P.ring_area(P.convex_hull(ring))), long_, short, float(np.degrees(angle)), share, main, len(P.crossings(ring))])
        return [pa.array([None if r[k] is None else float(r[k]) for r in rows], pa.float64()) for k in range(6)] + [pa.array([r[6] for r in rows], pa.int64())]

    return _added(df, "hull_area double;long_side double;short_side double;direction double;rectilinear double;main double;crossings bigint", shapes)


def with_shape_distances(pairs: DataFrame, left: str = "l_geom", right: str = "r_geom") -> DataFrame:
    """Add hausdorff, boundary, turning, hu, orientation and elongation of each pair of outer rings; null without both.

    The descriptors of a polygon are computed once a batch, however many pairs
    it stands in.
    """

    def distances(batch: pa.RecordBatch) -> list[pa.Array]:
        known: dict[bytes, tuple] = {}

        def described(ring: np.ndarray) -> tuple:
            key = ring.tobytes()
            if key not in known:
                known[key] = P.turning(ring), P.hu_moments(ring), P.least_rectangle(ring)
            return known[key]

        rows = []
        for a, b in zip(_outer_rings(batch.column(left)), _outer_rings(batch.column(right))):
            if a is None or b is None:
                rows.append([None] * 6)
                continue
            (ta, ha, ra), (tb, hb, rb) = described(a), described(b)
            between = abs(ra[2] - rb[2]) % np.pi
            stretch = [max(r[0], 1e-9) / max(r[1], 1e-9) for r in (ra, rb)]
            rows.append([P.hausdorff(a, b), P.boundary_distance(a, b), P.turning_distance(ta, tb), float(np.abs(ha - hb).sum()), float(min(between, np.pi - between) / (np.pi / 2)), float(min(stretch) / max(stretch))])
        return [pa.array([r[k] for r in rows], pa.float64()) for k in range(6)]

    return _added(pairs, "hausdorff double;boundary double;turning double;hu double;orientation double;elongation double", distances)


def repaired(layer: DataFrame, digits: int = 3, spike_degrees: float = 6.0, twin: float = 0.005) -> DataFrame:
    """``layer`` (fid, geom) with geom made valid, and the actions taken, in their order.

    cut_at_crossings keeps the largest simple part of an outer ring that crosses
    itself; doubled vertices and spikes are taken out; coordinates are rounded
    and outer rings run counter-clockwise.  A polygon without any area left has
    a null geom and the action dropped.
    """

    def mend(batch: pa.RecordBatch) -> list[pa.Array]:
        shapes, actions = [], []
        for value in batch.column("geom").to_pylist():
            done: list[str] = []
            mended = []
            for k, points in enumerate((value or {}).get("rings") or []):
                ring = np.array([(p["x"], p["y"]) for p in points or [] if p and p["x"] is not None and p["y"] is not None], float).reshape(-1, 2)
                if len(ring) < 3 or not np.isfinite(ring).all():
                    ring = None
                else:
                    ring = P.closed_ring(ring)
                    if P.crossings(ring):
                        ring = P.largest_part(ring)
                        done.append("cut_at_crossings")
                    if ring is not None:
                        ring, what = _cleaned_ring(ring, twin, spike_degrees)
                        done += what
                if ring is not None:
                    rounded = np.round(ring, digits)
                    ring = rounded if len(rounded) >= 4 and abs(P.ring_area(rounded)) > 0 else None
                if ring is None:
                    if k == 0:
                        mended = []
                        done.append("dropped")
                        break
                    done.append("hole_dropped")
                    continue
                if (P.ring_area(ring) > 0) != (k == 0):
                    ring = ring[::-1]
                    done.append("turned")
                mended.append([{"x": float(x), "y": float(y)} for x, y in ring])
            shapes.append({"kind": "Polygon", "rings": mended} if mended else None)
            actions.append(list(dict.fromkeys(done)))
        kind = pa.struct([("kind", pa.string()), ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))])
        return [pa.array(shapes, kind), pa.array(actions, pa.list_(pa.string()))]

    return _added(layer, f"_mended {GEOM};actions array<string>", mend).withColumn("geom", F.col("_mended")).drop("_mended")


def _cleaned_ring(ring: np.ndarray, twin: float, degrees: float) -> tuple[np.ndarray | None, list[str]]:
    """A closed ring without doubled vertices and spikes; None if fewer than three vertices stay."""
    done, points = [], ring[:-1]
    while len(points) >= 3:
        apart = np.hypot(*(points - np.roll(points, 1, axis=0)).T)
        if (apart < twin).any():
            points = points[apart >= twin]
            done.append("doubled_vertices")
            continue
        back, on = np.roll(points, 1, axis=0) - points, np.roll(points, -1, axis=0) - points
        cosine = (back * on).sum(1) / np.hypot(*back.T) / np.hypot(*on.T)
        sharp = np.arccos(np.clip(cosine, -1, 1)) < np.radians(degrees)
        if not sharp.any():
            break
        points = np.delete(points, int(np.argmax(sharp)), axis=0)
        done.append("spikes")
    return (P.closed_ring(points) if len(points) >= 3 else None), list(dict.fromkeys(done))


def regularised(layer: DataFrame, tolerance: float = 0.3, degrees: float = 12.0, least_share: float = 0.55, most_change: float = 0.12) -> DataFrame:
    """``layer`` (fid, geom) with outer rings simplified and squared, as regular, method and vertices before and after.

    A ring is squared if enough of it runs along or across its main direction
    and its area changes by no more than ``most_change``; else it is only
    simplified.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        out, method, before, after = [], [], [], []
        for ring in _outer_rings(batch.column("geom")):
            if ring is None:
                out.append(None), method.append(None), before.append(None), after.append(None)
                continue
            plain = P.simplified(ring, tolerance)
            best, how = (plain, "simplified") if len(plain) >= 4 and not P.crossings(plain) else (ring, "kept")
            if P.rectilinearity(best, degrees)[0] >= least_share:
                square = P.squared(best, degrees)
                if square is not None and abs(abs(P.ring_area(square)) / max(abs(P.ring_area(ring)), 1e-9) - 1) <= most_change:
                    best, how = square, "squared"
            out.append({"kind": "Polygon", "rings": [[{"x": float(x), "y": float(y)} for x, y in best]]})
            method.append(how), before.append(len(ring) - 1), after.append(len(best) - 1)
        kind = pa.struct([("kind", pa.string()), ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))])
        return [pa.array(out, kind), pa.array(method, pa.string()), pa.array(before, pa.int64()), pa.array(after, pa.int64())]

    return _added(layer, f"regular {GEOM};method string;vertices_before bigint;vertices_after bigint", make)


def vertices(layer: DataFrame) -> DataFrame:
    """(fid, ring, nth, x, y) of every vertex; the closing one is left out."""
    rings = layer.select("fid", F.posexplode("geom.rings").alias("ring", "_r"))
    return rings.select("fid", "ring", F.posexplode(F.slice(F.col("_r"), F.lit(1), F.greatest(F.size("_r") - 1, F.lit(0)))).alias("nth", "_p")).select("fid", "ring", "nth", "_p.x", "_p.y")


def snap_moves(layer: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """(fid, ring, nth, x, y, to_x, to_y, distance): vertices near one of a feature of smaller id move onto the nearest.

    Only vertices of smaller ids draw others, so no two features trade places
    and the outcome does not depend on any order.
    """
    v = vertices(layer)
    spot = v.select("*", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    away = F.hypot(F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y"))
    near = box_join(spot, spot, tolerance, 8.0).where("r_fid < l_fid").withColumn("distance", away).where((F.col("distance") <= tolerance) & (F.col("distance") > 0))
    nearest = near.groupBy("l_fid", "l_ring", "l_nth").agg(F.first("l_x").alias("x"), F.first("l_y").alias("y"), F.min(F.struct("distance", "r_fid", "r_ring", "r_nth", "r_x", "r_y")).alias("n"))
    return nearest.select(F.col("l_fid").alias("fid"), F.col("l_ring").alias("ring"), F.col("l_nth").alias("nth"), "x", "y", F.col("n.r_x").alias("to_x"), F.col("n.r_y").alias("to_y"), F.col("n.distance").alias("distance"))


def snapped(layer: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """``layer`` (fid, geom) with its vertices moved by ``snap_moves``; adds moved, the number of vertices, and furthest."""
    moves = snap_moves(layer, tolerance).groupBy("fid").agg(F.collect_list(F.struct("ring", "nth", "to_x", "to_y")).alias("_m"), F.max("distance").alias("furthest"))
    joined = layer.join(moves, "fid", "left")

    def moved(p: Column, ring: Column, nth: Column) -> Column:
        hit = F.get(F.filter(F.coalesce("_m", F.array().cast("array<struct<ring:int,nth:int,to_x:double,to_y:double>>")), lambda m: (m["ring"] == ring) & (m["nth"] == nth)), F.lit(0))
        return F.struct(F.coalesce(hit["to_x"], p["x"]).alias("x"), F.coalesce(hit["to_y"], p["y"]).alias("y"))

    rings = F.transform("geom.rings", lambda r, k: F.transform(r, lambda p, i: moved(p, k, F.when(i == F.size(r) - 1, 0).otherwise(i))))
    return joined.withColumn("geom", F.struct(F.col("geom.kind").alias("kind"), rings.alias("rings"))).withColumn("moved", F.coalesce(F.size("_m"), F.lit(0))).withColumn("moved", F.greatest("moved", F.lit(0))).drop("_m")


def field_sketch(ring: Column) -> Column:
    """Base line between the two farthest vertices of an outer ring, and chainage, offset and side of every vertex along it."""
    last = F.greatest(F.size(ring) - 1, F.lit(0))
    points = F.slice(ring, F.lit(1), last)
    far = F.flatten(F.transform(points, lambda a, i: F.transform(F.filter(F.transform(points, lambda b, j: F.struct(b["x"].alias("x"), b["y"].alias("y"), j.alias("j"))), lambda b: b["j"] > i), lambda b: F.struct(F.hypot(a["x"] - b["x"], a["y"] - b["y"]).alias("length"), F.negative(i).alias("i"), F.negative(b["j"]).alias("j"), a.alias("a"), b.alias("b")))))
    base = F.array_max(F.transform(far, lambda f: F.struct(F.round(f["length"], 9).alias("length"), f["i"].alias("i"), f["j"].alias("j"), f["a"].alias("a"), f["b"].alias("b"))))
    ux, uy = (base["b"]["x"] - base["a"]["x"]) / base["length"], (base["b"]["y"] - base["a"]["y"]) / base["length"]

    def told(p: Column, i: Column) -> Column:
        dx, dy = p["x"] - base["a"]["x"], p["y"] - base["a"]["y"]
        offset = dx * uy - dy * ux
        return F.struct(i.alias("nth"), (dx * ux + dy * uy).alias("chainage"), F.abs(offset).alias("offset"), F.when(F.abs(offset) < 1e-6, "on").when(offset > 0, "right").otherwise("left").alias("side"))

    return F.when(base["length"] > 0, F.struct(base["length"].alias("base_line"), F.transform(points, told).alias("stations")))
