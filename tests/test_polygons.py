from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave.functions import polygons as P
from terraweave.operators import overlay as O


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def geom(*rings):
    return ("Polygon", [[(float(x), float(y)) for x, y in r] for r in rings])


BOWTIE = [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]


def layer(spark, shapes):
    df = spark.createDataFrame(list(shapes.items()), f"fid string, geom {O.GEOM}")
    return df.select("*", O.envelope(F.col("geom")).alias("_b")).select("fid", "geom", "_b.*")


def test_overlaps_holes_parts_and_bowties(spark):
    rows = [
        (1, geom(box(0, 0, 10, 10)), geom(box(9, 0, 10, 10)), 100, 100, 10),
        (2, geom(box(5e5, 1e6, 10, 10), box(5e5 + 2, 1e6 + 2, 4, 4)), geom(box(5e5 + 3, 1e6 + 3, 10, 10)), 84, 100, 40),
        (3, geom(BOWTIE), geom(box(0, 0, 10, 10)), 50, 100, 50),
        (4, geom(box(0, 0, 1, 1), box(5, 5, 2, 2)), geom(box(0, 0, 10, 10)), 5, 100, 5),
        (5, None, geom(box(0, 0, 1, 1)), 0, 1, 0),
        (6, geom(), geom(box(0, 0, 1, 1)[:-1]), 0, 1, 0),
        (7, geom(box(0, 0, 4, 4)), geom(box(4, 0, 4, 4)), 16, 16, 0),
        (8, geom(box(0, 0, 4, 4)), geom(box(0, 0, 4, 4)), 16, 16, 16),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], f"id int, l_geom {O.GEOM}, r_geom {O.GEOM}").withColumn("shared_by", F.lit("clash"))
    got = {r.id: (r.area_l, r.area_r, r.shared) for r in O.with_overlay(df).collect()}
    assert {k: tuple(round(v, 6) for v in t) for k, t in got.items()} == {r[0]: tuple(map(float, r[3:])) for r in rows}
    assert O.with_overlay(df.limit(0)).count() == 0


def test_random_overlays_equal_a_fine_count(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(7)
    kind = pa.struct([("kind", pa.string()), ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))])

    def star(k):
        angle = (np.arange(k) + 0.8 * rng.random(k)) / k * 2 * np.pi
        r = 2 + 3 * rng.random(k)
        p = np.column_stack([5 + rng.random() * 3 + r * np.cos(angle), 5 + r * np.sin(angle)])
        return np.vstack([p, p[:1]])

    shapes = [(star(rng.integers(3, 12)), star(rng.integers(3, 12))) for _ in range(12)]
    arrays = [pa.array([{"kind": "Polygon", "rings": [[{"x": x, "y": y} for x, y in s[k]]]} for s in shapes], kind) for k in (0, 1)]
    edges = [P.edges_of(a) for a in arrays]
    a, b, shared = P.overlay_areas(*edges, len(shapes))
    at = (np.arange(900) + 0.5) / 900 * 16 - 2
    gx, gy = np.meshgrid(at, at)
    for k, (s, t) in enumerate(shapes):
        both = P.contains(s, gx, gy) & P.contains(t, gx, gy)
        assert abs(both.sum() * (16 / 900) ** 2 - shared[k]) < 0.06
        assert abs(abs(P.ring_area(s)) - a[k]) < 1e-9 and abs(abs(P.ring_area(t)) - b[k]) < 1e-9
    monkeypatch.setattr(P, "MOST_AT_ONCE", 7)
    assert np.allclose(P.overlay_areas(*edges, len(shapes))[2], shared)


def test_shapes():
    ring = np.array(box(0, 0, 4, 10), float)
    assert P.least_rectangle(ring)[:2] == (10.0, 4.0) and P.rectilinearity(ring)[0] == 1.0
    assert P.hausdorff(ring, ring + [1, 0]) == 1.0
    small, large = np.array(box(0, 0, 5, 5), float), np.array(box(0, 0, 100, 100), float)
    assert abs(P.boundary_distance(small, small + [1, 0]) - P.boundary_distance(large, large + [1, 0])) < 0.26
    assert P.turning_distance(P.turning(ring), P.turning(ring * 3)) < 1e-9 < P.turning_distance(P.turning(ring), P.turning(small))
    assert np.abs(P.hu_moments(small) - P.hu_moments(large)).max() < 1e-9
    circle = np.array([(np.cos(a), np.sin(a)) for a in np.linspace(0, 2 * np.pi, 41)]) * 10
    assert P.rectilinearity(circle)[0] < 0.4 < P.rectilinearity(ring)[0]
    wobbly = np.vstack([np.column_stack([np.linspace(0, 20, 21)[:-1], 0.1 * np.sin(np.arange(20))]), [(20, 0), (20, 12), (0, 12), (0, 0)]])
    assert len(P.simplified(wobbly, 0.3)) == 5
    assert abs(abs(P.ring_area(P.largest_part(np.array(BOWTIE)))) - 25) < 1e-9


def test_repair_and_snap(spark):
    rng = random.Random(3)
    spike = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 10.0), (5.0, 90.0), (5.001, 10.0), (0.0, 10.0), (0.0, 0.0)]
    wobble = [(x + rng.uniform(-0.05, 0.05), y) for x, y in box(0, 0, 20, 12)[:-1]]
    shapes = {"tie": geom(BOWTIE), "spike": geom(spike), "double": geom([(0.0, 0.0), (0.001, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]), "back": geom(box(0, 0, 3, 3)[::-1]), "line": geom([(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), "none": None, "fine": geom([*wobble, wobble[0]])}
    got = {r.fid: r for r in O.repaired(layer(spark, shapes)).withColumn("area", O.polygon_area(F.col("geom"))).collect()}
    assert got["tie"].actions == ["cut_at_crossings"] and abs(got["tie"].area - 25) < 0.01
    assert "spikes" in got["spike"].actions and abs(got["spike"].area - 100) < 0.1
    assert "doubled_vertices" in got["double"].actions and got["back"].actions == ["turned"] and got["fine"].actions == []
    assert got["line"].geom is None and got["line"].actions[-1] == "dropped" and got["none"].geom is None
    near = layer(spark, {"a": geom(box(0, 0, 10, 10)), "b": geom(box(10.1, 0, 10, 10)), "c": geom(box(40, 0, 10, 10))})
    moved = {r.fid: r for r in O.snapped(near).withColumn("area", O.polygon_area(F.col("geom"))).collect()}
    assert moved["a"].moved == 0 and moved["b"].moved == 2 and abs(moved["b"].area - 101) < 1e-6 and moved["c"].moved == 0
    assert moved["b"].geom.rings[0][0].x == 10.0 and moved["b"].geom.rings[0][-1].x == 10.0


def test_largest_share_and_sketch(spark):
    houses, plots = layer(spark, {"h1": geom(box(8, 0, 4, 4)), "h2": geom(box(50, 0, 4, 4))}), layer(spark, {"p": geom(box(0, 0, 9, 9)), "q": geom(box(9, 0, 9, 9)), "hole": geom(box(-100, -100, 300, 300), box(-50, -50, 200, 200))})
    got = {r.fid: (r.parent, r.covered) for r in O.largest_share(houses, plots).collect()}
    assert got == {"h1": ("q", 12.0), "h2": (None, 0.0)}
    sketch = layer(spark, {"r": geom(box(0, 0, 30, 20)), "n": None}).select("fid", O.field_sketch(F.get("geom.rings", F.lit(0))).alias("s")).collect()
    by = {r.fid: r.s for r in sketch}
    assert round(by["r"].base_line, 2) == 36.06 and {s.side for s in by["r"].stations} == {"on", "left", "right"} and by["n"] is None


@pytest.mark.parametrize("cell", [1.0, 32.0])
def test_regular_footprints(spark, cell):
    ring = [(0.0, 0.0), (10.0, 0.4), (20.0, 0.2), (20.3, 12.0), (0.2, 11.8), (0.0, 0.0)]
    got = O.regularised(layer(spark, {"a": geom(ring), "n": None})).collect()
    a = next(r for r in got if r.fid == "a")
    assert a.method == "squared" and a.vertices_after <= a.vertices_before == 5
    assert O.overlay_join(layer(spark, {"a": geom(ring)}), layer(spark, {"b": geom(box(0, 0, 20, 12))}), cell=cell).count() == 1
