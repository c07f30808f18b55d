from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.operators.profile import control_limits, coordinate_digits, departures, profile_loads

GEOM = "struct<kind:string,rings:array<array<struct<x:double,y:double>>>>"
FEATURES = f"dataset_id string, run_id string, properties map<string,string>, geom {GEOM}"
PROFILE = "dataset_id string, attribute string, feature_count bigint, attribute_null_rate double, attribute_cardinality bigint, value_pattern string, pattern_share double, value_median double, coordinate_precision_digits int"
EXPECTED = [
    ("D", "key", 100, 0.0, 100, r"K\d+", 1.0, None, None), ("D", "size", 100, 0.0, 50, None, None, 10.0, None), ("D", "gone", 100, 0.0, 2, None, None, None, None), ("D", "geom", 100, 0.0, 99, None, None, None, 7),
]


def point(x, y):
    return ("Point", [[(x, y)]])


def test_measures(spark):
    good = [("D", "r1", {"key": f"K{i}", "size": str(8 + i % 5), "gone": "x"}, point(80.1234567, 11.7654321)) for i in range(20)]
    bad = [("D", "r2", {"key": f"L{i % 5}", "size": "21" if i < 10 else "20.5", "gone": " "}, point(80.12345, 11.76543)) for i in range(20)]
    few = [("D", "r3", {"key": "L"}, None)] * 19
    features, profile = spark.createDataFrame(good + bad + few, FEATURES), spark.createDataFrame(EXPECTED, PROFILE)
    found = departures(profile_loads(features, profile, ["dataset_id", "run_id"]), profile, ["dataset_id", "run_id"]).collect()
    assert {(r.run_id, r.attribute, r.measure) for r in found} == {("r2", "key", "cardinality"), ("r2", "key", "pattern"), ("r2", "size", "distribution"), ("r2", "gone", "null_rate"), ("r2", "geom", "precision")}


def test_median_straddles_the_limit(spark):
    # Half of the values lie above twice the median; the mean of the middle two decides.
    for middle, hit in (((19.0, 21.5), True), ((18.0, 21.5), False)):
        rows = [("D", "r", {"size": str(v)}, None) for v in [1.0] * 9 + [*middle] + [30.0] * 9]
        features, profile = spark.createDataFrame(rows, FEATURES), spark.createDataFrame(EXPECTED, PROFILE)
        found = departures(profile_loads(features, profile, ["dataset_id", "run_id"]), profile, ["dataset_id", "run_id"]).where("measure = 'distribution'").count()
        assert (found == 1) == hit


def test_empty_null_and_long(spark):
    profile = spark.createDataFrame(EXPECTED, PROFILE)
    assert profile_loads(spark.createDataFrame([], FEATURES), profile, ["dataset_id", "run_id"]).count() == 0
    rows = [(None, None, None, None), ("D", None, {"key": "K" * 100_000, "size": None}, ("Polygon", []))]
    got = {(r.dataset_id, r.attribute): r for r in profile_loads(spark.createDataFrame(rows, FEATURES).withColumn("value", F.lit(1)), profile, ["dataset_id", "run_id"]).collect()}
    assert got["D", "key"]["values"] == 1 and got["D", "size"]["values"] == 0 and got["D", "geom"]["digits"] is None


def test_digits_and_control_limits(spark):
    df = spark.createDataFrame([(point(80.5, 11.25),), (point(81.0, 12.0),), (None,), (point(float("nan"), 1e300),)], f"geom {GEOM}")
    assert [r[0] for r in df.select(coordinate_digits(F.col("geom"))).collect()] == [2, 0, None, None]
    metrics = spark.createDataFrame([("a", i, 1.0 + (i % 2) * 0.01 if i < 9 else 9.0) for i in range(10)], "k string, t int, v double")
    assert [r.t for r in control_limits(metrics, ["k"], "t", "v").where("out_of_control").collect()] == [9]
