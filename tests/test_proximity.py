from __future__ import annotations

import numpy as np
import pytest

from terraweave.operators.proximity import near_and_within


def brute(points, regions, d):
    out = set()
    for i, (a, xa, ya) in enumerate(points):
        for b, xb, yb in points[i + 1 :]:
            if a != b and np.hypot(xa - xb, ya - yb) <= d:
                out.add((min(a, b), max(a, b), "near"))
    for r, rings in regions:
        for p, x, y in points:
            inside = False
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                    if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                        inside = not inside
            if inside:
                out.add((min(r, p), max(r, p), "within"))
    return out


GEOM = "struct<kind:string,rings:array<array<struct<x:double,y:double>>>>"


def frames(spark, points, regions):
    p = spark.createDataFrame(points, "id bigint, x double, y double")
    r = spark.createDataFrame([(i, ("Polygon", rings)) for i, rings in regions], f"id bigint, geom {GEOM}")
    return p, r


@pytest.mark.parametrize("rows_per_cell", [3, 20, 10_000])
def test_equals_brute_force(spark, rows_per_cell):
    rng = np.random.default_rng(7)
    xy = np.vstack([rng.uniform(0, 200, (120, 2)), rng.normal(50, 1, (30, 2)), np.full((10, 2), 80.0)])
    points = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(xy)]
    square = [(20.0, 20.0), (150.0, 20.0), (150.0, 150.0), (20.0, 150.0), (20.0, 20.0)]
    hole = [(40.0, 40.0), (60.0, 40.0), (60.0, 60.0), (40.0, 60.0), (40.0, 40.0)]
    regions = [(1000, [square, hole]), (1001, [[(0.0, 0.0), (90.0, 10.0), (10.0, 90.0), (0.0, 0.0)]])]
    got = near_and_within(*frames(spark, points, regions), 12.0, rows_per_cell).select("id_a", "id_b", "relation").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(points, regions, 12.0)


def test_nulls_empty_and_extra_columns(spark):
    p, r = frames(spark, [(1, 0.0, 0.0), (2, None, 1.0), (None, 0.0, 1.0), (3, float("nan"), 0.0), (4, 3.0, 4.0)], [(9, [])])
    p = p.withColumn("strip", p.x)
    assert {tuple(x) for x in near_and_within(p, r, 5.0).collect()} == {(1, 4, "near", 5.0)}
    assert near_and_within(p.limit(0), r.limit(0), 5.0).count() == 0
    assert near_and_within(p, None, 5.0).count() == 1
