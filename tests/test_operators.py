"""Hand-computable cases of the reference operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from terraweave.functions import crs, geodesy, identifiers, rings
from terraweave.operators import evidence, graph, grid, ledger, linkage, measures

BOXES = "fid bigint, x1 double, y1 double, x2 double, y2 double"
RING = "ring array<struct<x:double,y:double>>"


def ring_of(spark, points):
    return spark.createDataFrame([(points,)], RING)


def one(df, *columns):
    return tuple(df.select(*columns).first())


def test_overlap_of_two_boxes(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 9.0, 0.0, 19.0, 10.0)], BOXES)
    got = grid.box_join(df, df, 0.0, 4.0).where("l_fid < r_fid").select(grid.overlap()).collect()
    assert [r[0] for r in got] == [10.0]


def test_ring_rules(spark):
    bowtie = ring_of(spark, [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)])
    sliver = ring_of(spark, [(0.0, 0.0), (40.0, 0.0), (40.0, 0.05), (0.0, 0.05), (0.0, 0.0)])
    square = ring_of(spark, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)])
    r = F.col("ring")
    assert one(bowtie, rings.crosses_itself(r)) == (True,)
    assert "sliver" in one(sliver, rings.violations(r))[0]
    assert one(square, rings.violations(r), rings.area(r), rings.perimeter(r)) == ([], 16.0, 16.0)
    assert one(square, rings.spikes(r), rings.duplicate_vertices(r), rings.crosses_itself(r)) == (0, 0, False)


def test_wkt_round_trip(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))",), ("POINT (3 4.5)",), ("EMPTY",), (None,)], "t string")
    got = [r[0] for r in df.select(rings.wkt(rings.from_wkt(F.col("t")))).collect()]
    assert got == ["POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 1.0))", "POINT (3.0 4.5)", None, None]


def test_utm_round_trip():
    x, y = crs.to_utm_np([81.0, 80.95, 82.4], [11.0, 10.95, 12.4])
    lon, lat = crs.from_utm_np(x, y)
    assert abs(x[0] - 500000) < 1e-6 and max(abs(lon - [81.0, 80.95, 82.4])) < 1e-11 and max(abs(lat - [11.0, 10.95, 12.4])) < 1e-11


def test_geodesy(spark):
    df = spark.range(1)
    a = [F.lit(v) for v in (80.2425, 13.0777, 80.25, 13.0)]
    far, round_ = one(df, geodesy.vincenty(*a), geodesy.haversine(*a))
    assert abs(far - round_) / far < 0.006
    lon, lat, h = one(df, *geodesy.from_ecef(*geodesy.to_ecef(F.lit(80.25), F.lit(13.08), F.lit(12.5))))
    assert abs(lon - 80.25) < 1e-10 and abs(lat - 13.08) < 1e-9 and abs(h - 12.5) < 1e-3
    cell = ring_of(spark, [(80.0, 13.0), (80.01, 13.0), (80.01, 13.01), (80.0, 13.01), (80.0, 13.0)])
    area = one(cell, geodesy.ring_area(F.col("ring")))[0]
    assert math.isclose(area, 1084.7 * 1106.3, rel_tol=2e-3)


def test_every_substitution_changes_the_check_character(spark):
    body = "33571GCC0123"
    alphabet = identifiers.CHECK32
    texts = [body] + [body[:k] + c + body[k + 1 :] for k in range(len(body)) for c in alphabet if c != body[k]]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(identifiers.check_character(F.col("t"))).collect()]
    assert all(c != got[0] for c in got[1:])


def test_identifier_parts(spark):
    df = spark.createDataFrame([("G+2", "Ward 007"), ("B+G+5", "12"), ("3", None), ("x", "-")], "f string, w string")
    assert [tuple(r) for r in df.select(identifiers.floors(F.col("f")), identifiers.ward(F.col("w"))).collect()] == [(3, "7"), (6, "12"), (3, None), (None, None)]
    assert one(spark.range(1), identifiers.geohash(F.lit(-5.60302734375), F.lit(42.60498046875), 5))[0] == "ezs42"


def test_evidence_agreement_and_conflict(spark):
    rows = [(1, "d1", "a", 0.6), (1, "d2", "a", 0.5), (2, "d1", "a", 0.8), (2, "d2", "b", 0.8), (3, "d1", "a", 0.7)]
    ev = spark.createDataFrame(rows, "e bigint, dataset string, value string, mass double")
    k = {r.e: r.conflict for r in evidence.conflict_mass(ev, ["e"], ["dataset"]).collect()}
    assert k[1] == 0 and k[2] > 0.5
    f = {(r.e, r.value): r.belief for r in evidence.fused(ev, ["e"]).collect()}
    assert math.isclose(f[1, "a"], 0.8) and math.isclose(f[2, "a"], f[2, "b"])
    r = {x.e: x for x in evidence.resolved(ev, ["e"]).collect()}
    assert (r[1].strategy, r[2].strategy, r[3].strategy) == ("unanimous", "fusion", "single_source") and math.isclose(r[3].belief, 0.7)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (None, 3)]
    nodes = spark.createDataFrame([(k,) for k in [*range(41), *range(100, 120), 500]], "node bigint")
    got = {r.node: r.component for r in graph.components(nodes, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 120)} == {100} and got[500] == 500


def test_ledger_and_merkle(spark):
    entries = spark.createDataFrame([(k, f"p{k}") for k in range(50)], "index bigint, payload string")
    chain = ledger.chained(entries)
    assert ledger.verified(chain).where("NOT holds").count() == 0
    forged = chain.withColumn("payload", F.when(F.col("index") == 7, "x").otherwise(F.col("payload")))
    assert [r["index"] for r in ledger.verified(forged).where("NOT holds").collect()] == [7]
    leaves = spark.createDataFrame([(k, f"{k:064x}") for k in range(37)], "index bigint, hash string")
    root = ledger.merkle_root(leaves).first()[0]
    for k in (0, 18, 36):
        proof = ledger.inclusion_proof(leaves, k)
        assert ledger.proof_holds(f"{k:064x}", proof, root) and not ledger.proof_holds("0" * 63 + "f", proof, root)


def test_re_registration_is_no_change(spark):
    base = "fid bigint, x1 double, y1 double, x2 double, y2 double, ward int, land_use string"
    boxes = [(k, 20.0 * k, 0.0, 20.0 * k + 10, 10.0, 1, "u") for k in range(40)]
    moved = [(k, a + 1.2, b + 0.4, c + 1.2 + (4.0 if k == 7 else 0.0), d + 0.4, w, u) for k, a, b, c, d, w, u in boxes]
    left, right = spark.createDataFrame(boxes, base), spark.createDataFrame(moved, base)
    scored = linkage.scored_pairs(left, right)
    o = linkage.registration_offset(scored).first()
    assert (round(o.dx, 6), round(o.dy, 6)) == (1.2, 0.4)
    links = linkage.mutual_assignment(scored).where("state = 'accepted'")
    kinds = {r.fid: r.change for r in linkage.changes(left, right, links, (o.dx, o.dy)).collect()}
    assert [k for k, v in kinds.items() if v != "no_change"] == [7] and kinds[7] == "extension"


def test_grades(spark):
    df = spark.createDataFrame([(0.95,), (0.75,), (0.6,), (0.4,), (0.1,)], "c double")
    assert [r[0] for r in df.select(measures.grade(F.col("c"))).collect()] == list("ABCDE")
