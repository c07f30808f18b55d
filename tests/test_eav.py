from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terraweave.functions import values as V
from terraweave.operators.eav import eav_to_wide, wide_cells

FIELDS = [
    ("survey_number", "identity", "str", None, ["survey_no"], None), ("ward", "admin", "int", None, None, None), ("village", "admin", "str", None, ["v_code"], None), ("zone", "admin", "int", None, ["zone_no"], None),
    ("extent_m2", "extent", "float", "m2", ["shape_area"], None), ("use", "use", "str", None, [], ["mixed_use", "vacant"]), ("is_active", "status", "bool", None, ["active"], None),
]
SCHEMA = "id bigint, d string, s string, property_path string, value_text string, value_num double, observed_on date"


@pytest.fixture(scope="module")
def fields(spark):
    return spark.createDataFrame(FIELDS, "field_name string, kind string, dtype string, unit string, aliases array<string>, value_domain array<string>")


def cells(spark, fields, rows):
    claims = spark.createDataFrame([(i, "D", s, p, t, n, o) for i, (s, p, t, n, o) in enumerate(rows)], SCHEMA)
    return {(r.s, r.field_name): r.value_key for r in wide_cells(eav_to_wide(claims, fields, ["d", "s"]), ["d", "s"]).collect()}


def test_spellings_units_and_precedence(spark, fields):
    day = dt.date
    got = cells(spark, fields, [
        ("a", "Survey No", "0437 - 2 a", None, day(2020, 1, 1)), ("a", "attr.surveyNo", "?", 5.0, day(2019, 1, 1)), ("a", "survey_number_quality", "12", None, day(2024, 1, 1)),
        ("a", "zone_no", "Zone IX", None, None), ("a", "ZONE", "-1", None, day(2024, 1, 1)), ("a", "extent-m2", "1,000.50 sq.m", None, None), ("b", "x.Shape_Area", "0.25 ha", None, None),
        ("b", "USE", "Mixed-Use ", None, None), ("b", "use", "palace", None, day(2024, 1, 1)), ("b", "active", "N", None, None), ("b", "v-code", " 600013.0", None, None), ("c", "ward", "W-20", None, day(2020, 1, 1)),
        ("c", "ward", None, 7.0, day(2021, 1, 1)), ("c", "ward", None, -1.0, day(2022, 1, 1)), ("d", "ward", "n/a", None, None), ("e", None, "3", None, None), (None, "ward", "3", None, None),
    ])
    assert got == {
        ("a", "survey_number"): "437/2A", ("a", "zone"): "9", ("a", "extent_m2"): "100050", ("b", "extent_m2"): "250000", ("b", "use"): "mixed_use", ("b", "is_active"): "false", ("b", "village"): "600013", ("c", "ward"): "7",
    }


def test_ties_and_repeats_and_empty(spark, fields):
    same = dt.date(2020, 5, 5)
    assert cells(spark, fields, [("a", "ward", "3", None, same), ("a", "ward", "4", None, same), ("a", "ward", "4", None, same)]) == {("a", "ward"): "3"}
    empty = spark.createDataFrame([], SCHEMA).withColumn("value", F.lit(1)).withColumn("dtype", F.lit("x"))
    wide = eav_to_wide(empty, fields, ["d", "s"])
    assert wide.count() == 0 and set(wide.columns) == {"d", "s", *[f[0] for f in FIELDS]}


@pytest.mark.parametrize(("raw", "expected"), [("437", "437"), ("437/2A", "437/2A"), ("437 / 2 A", "437/2A"), ("0437-2A", "437/2A"), ("437.2A", "437/2A"), ("௪௩௭", "437"), ("61//2A ", "61/2A"), ("pending", None), ("", None), ("9" * 5000, "9" * 5000)])
def test_survey_numbers(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "t string").select(V.survey_normal_form(V.squeezed(F.col("t")))).first()[0] == expected


def test_strange_numbers_do_not_fail(spark, fields):
    inf = float("inf")
    assert cells(spark, fields, [("a", "ward", None, v, None) for v in (float("nan"), inf, -inf, 1e300, -1.0)] + [("b", "extent_m2", None, 1e300, None), ("b", "extent", "1" * 400, None, None), ("c", "ward", "12" * 5000, None, None)]) in ({}, {("b", "extent_m2"): str(2**63 - 1)})
