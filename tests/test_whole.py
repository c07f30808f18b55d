"""Queries that take all of their input."""

from __future__ import annotations

import math
import os
from collections import Counter

import pytest
from oracle import oracle_rows, rows_of

from terraweave.operators import raster
from terraweave.queries import catalogue


@pytest.fixture(scope="session")
def larger(sf_dir):
    """On the smallest tables the part is all there is."""
    return os.path.join(os.path.dirname(sf_dir), "sf0.01")


def test_zonal_takes_every_zone_on_the_raster(spark, larger):
    got = rows_of(catalogue.queries()["r6_zonal"](spark, larger))
    assert got == oracle_rows(catalogue.oracles()["r6_zonal"], larger)
    assert len(got[1]) > 4


def test_zones_spread_over_rows_are_not_broadcast(spark, sf_dir):
    plan = catalogue.queries()["r6_zonal"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_zone_between_two_centres_has_no_cells(spark):
    cells = spark.createDataFrame([(r, 0, float(r)) for r in range(3)], "r bigint, c bigint, z double")
    zones = spark.createDataFrame([(1, 0.0, 0.6, 1.0, 0.9), (2, 0.0, 0.5, 1.0, 1.5), (3, 0.0, None, 1.0, 1.5)], "fid int, x1 double, y1 double, x2 double, y2 double")
    assert [(r.fid, r.cells, r["mean"]) for r in raster.zonal(cells, zones).collect()] == [(2, 2, 0.5)]


def test_divergence_reads_the_whole_texts(spark, sf_dir):
    counts: dict[str, Counter] = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "text").collect():
        if r.text and len(r.text) > 1:
            counts.setdefault(r.source, Counter()).update(r.text[i : i + 2] for i in range(len(r.text) - 1))
    whole = sum(counts.values(), Counter())
    want = {}
    for source, own in counts.items():
        rest = whole - own
        a, b, out = sum(own.values()), sum(rest.values()), 0.0
        for gram in whole:
            p, q = own[gram] / a, rest[gram] / b
            out += sum(x * math.log2(2 * x / (p + q)) for x in (p, q) if x) / 2
        want[source] = out
    got = {r.source: r.divergence for r in catalogue.queries()["a23_texts"](spark, sf_dir).collect()}
    assert len(want) > 1 and got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 2e-6 for s in want)
