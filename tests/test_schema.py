from __future__ import annotations

from terraweave.operators.schema import applied, crosswalk

FIELDS = [("survey_number", "identity", "str", None, ["survey_no"], None), ("ward", "admin", "int", None, ["ward_no"], None), ("use", "use", "str", None, ["usage"], ["mixed_use", "vacant"])]


def test_names_and_values_decide(spark):
    fields = spark.createDataFrame(FIELDS, "field_name string, kind string, dtype string, unit string, aliases array<string>, value_domain array<string>")
    rows = [("D", "Survey_Number", f"{k}/1A") for k in range(9)] + [("D", "survey_number_note", "see file")] * 9 + [("D", "ward_num", "7")] * 5 + [("D", "USAGE", "Vacant")] * 5 + [("D", "colour", "red")] * 5 + [("E", "ward", None), ("E", "use", "palace")]
    values = spark.createDataFrame(rows, "dataset_id string, attribute string, value string")
    got = {(r.dataset_id, r.attribute): (r.field_name, r.state) for r in crosswalk(values, fields).collect()}
    assert got[("D", "Survey_Number")] == ("survey_number", "accepted")
    assert got[("D", "ward_num")] == ("ward", "accepted") and got[("D", "USAGE")] == ("use", "accepted")
    assert ("D", "colour") not in got and ("D", "survey_number_note") not in got and ("E", "ward") not in got
    assert applied(values, crosswalk(values, fields)).where("dataset_id = 'D'").count() == 19
    assert crosswalk(values.limit(0), fields).count() == 0
