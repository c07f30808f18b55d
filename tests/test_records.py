from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from terraweave.operators import records as S


def test_hull_of_batches(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(0, 10, (500, 2))
    df = spark.createDataFrame(p.tolist() + [[float("nan"), 1.0]], "x double, y double").repartition(5)
    from terraweave.functions import polygons as P

    assert abs(S.hull_area(df).first().area - abs(P.ring_area(P.convex_hull(p)))) < 1e-9
    assert S.hull_area(df.limit(0)).first().area == 0.0 and S.hull_area(df.limit(2)).first().area == 0.0


def test_holes_are_filled_ring_by_ring(spark):
    rows = [(r, c, None if 3 <= r <= 12 and 3 <= c <= 12 else 5.0) for r in range(16) for c in range(16)]
    got = S.filled(spark.createDataFrame(rows, "r int, c int, z double")).collect()
    assert len(got) == 256 and all(abs(r.z - 5.0) < 1e-9 for r in got)
    none = S.filled(spark.createDataFrame([(0, 0, None)], "r int, c int, z double")).collect()
    assert none[0].z is None


def test_shift_by_phase():
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, (96, 96))
    for k in range(4):
        a = (a + np.roll(a, 1, 0) + np.roll(a, 1, 1)) / 3
    assert S.phase_offset(a, np.roll(a, (4, -6), (0, 1)))[:2] == (4, -6)
    assert S.phase_offset(a, rng.normal(0, 1, (96, 96)))[2] < 0.2 and S.phase_offset(np.ones((8, 8)), np.ones((8, 8)))[2] == 0.0


def test_heights_reasons_and_ramps(spark):
    df = spark.createDataFrame([(7.5, 2.0), (0.5, 2.0), (None, 900.0), (None, None)], "s double, f double")
    assert [tuple(r[0]) for r in df.select(S.resolved_height(F.col("s"), F.col("f"))).collect()] == [(7.5, "stated"), (6.0, "floors"), (None, "none"), (None, "none")]
    assert [r[0] for r in df.select(S.first_failure({"low": F.col("s") < 1, "tall": F.col("f") > 100})).collect()] == [None, "low", "tall", None]
    cells = spark.createDataFrame([(0.0, 0.0, 0.0), (250.0, 250.0, 250.0), (100.0, 100.0, 100.0), (None, 0.0, 0.0)], "red double, green double, blue double")
    assert [r.value for r in S.ramp_values(cells, [(1.0, 0, 0, 0), (2.0, 255, 255, 255)]).collect()] == [1.0, 2.0, None, None]


def test_shared_values_and_groups(spark):
    v = spark.createDataFrame([(1, "A", "k", "x7"), (2, "B", "m", "x7"), (3, "A", "k", "res"), (4, "A", "k", "res"), (5, "B", "k", "res"), (6, "C", "q", "x7")], "id int, ds string, attribute string, value string")
    assert sorted((r.source_a, r.source_b, r.a.id, r.b.id) for r in S.shared_values(v, ["id", "attribute"], "ds").collect()) == [("A", "B", 1, 2), ("A", "C", 1, 6), ("B", "C", 2, 6)]
    g = spark.createDataFrame([(None, "x")] * 6 + [("y", "x")] * 5 + [(" ", None)] * 9, "a string, b string")
    assert [tuple(r) for r in S.top_groups(g, ["a", "b"]).collect()] == [("x", 6), ("y", 5)]


def test_publish_counts_what_it_writes(spark, tmp_path):
    df = spark.range(30).select(F.col("id").alias("k"))
    folder, counts = S.publish(spark, {"all": df, "top": df}, {"top": ([F.desc("k")], 4)})
    assert {r.part: r.rows for r in counts.collect()} == {"all": 30, "top": 4}
    assert sorted(json.loads(r.value)["k"] for r in spark.read.text(f"{folder}/top").collect()) == [26, 27, 28, 29]
