from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from terraweave.operators import resolution as R

CLAIM = "entity_id string, field_name string, kind string, dataset_id string, value string, id bigint, observed_on date, accuracy_m double, confidence double"
DATASETS = [("REV", "revenue_record", 8.0, ["CAD"]), ("CAD", "cadastral_map", 3.0, []), ("COPY", "cadastral_map", 5.0, ["REV"]), ("MUN", "municipal_gis", 1.0, None), ("LOOP1", "dsm", None, ["LOOP2"]), ("LOOP2", "dtm", None, ["LOOP1"]), ("S1", "dsm", None, []), ("S2", "dtm", None, [])]
DAY = dt.date(2025, 1, 1)


def datasets(spark):
    return spark.createDataFrame(DATASETS, "dataset_id string, source_type string, positional_accuracy_m double, lineage_parents array<string>")


def claims(spark, *rows):
    return spark.createDataFrame([(e, f, k, d, v, i, DAY, None, None) for i, (e, f, k, d, v) in enumerate(rows)], CLAIM).withColumn("roots", F.lit("x")).drop("roots")


def test_roots_follow_all_parents_and_end_in_loops(spark):
    got = {r.dataset_id: r.roots for r in R.lineage_roots(datasets(spark), 4).collect()}
    assert got["REV"] == got["CAD"] == got["COPY"] == "CAD" and got["MUN"] == "MUN" and got["LOOP1"] == got["LOOP2"] == "LOOP1"
    assert R.lineage_roots(datasets(spark).limit(0)).count() == 0


def test_shared_origin_lowers_belief(spark):
    rows = [("e", "ward", "admin", d, "3") for d in ("REV", "CAD", "COPY")] + [("e", "ward", "admin", "MUN", "4"), ("o", "ward", "admin", "MUN", "9")]
    c = claims(spark, *rows)
    mass = lambda discounted: {(r.entity_id, r.dataset_id): r.mass for r in R.weighed(c, datasets(spark), "2026-01-01", discounted).collect()}
    one, two = mass(False), mass(True)
    assert abs(two["e", "CAD"] - one["e", "CAD"] / 3**0.5) < 1e-12 and two["e", "MUN"] == one["e", "MUN"] and two["o", "MUN"] == one["o", "MUN"]


def test_the_ladder_of_decisions(spark):
    rows = [
        ("one", "land_use", "use", "CAD", "res"), ("same", "land_use", "use", "CAD", "res"), ("same", "land_use", "use", "MUN", "res"), ("rank", "survey_number", "identity", "MUN", "1"), ("rank", "survey_number", "identity", "CAD", "2"),
        ("rank", "survey_number", "identity", "REV", "3"), ("fuse", "x", "extent", "MUN", "a"), ("fuse", "x", "extent", "S1", "b"), ("fuse", "x", "extent", "S2", "b"),
    ]
    d = {r.entity_id: r for r in R.decided(R.weighed(claims(spark, *rows), datasets(spark), "2026-01-01")).collect()}
    assert {k: r.strategy for k, r in d.items()} == {"one": "single_source", "same": "unanimous", "rank": "precedence", "fuse": "fusion"}
    assert d["rank"].value == "3" and d["rank"].belief <= 0.99 and d["same"].belief == 1.0 and d["fuse"].value == "b" and not d["rank"].escalated
    assert R.decided(R.weighed(claims(spark, *rows).limit(0), datasets(spark), "2026-01-01")).count() == 0


def test_equal_beliefs_go_to_the_smaller_value_and_the_queue_ranks(spark):
    rows = [(e, "x", "extent", d, v) for e in ("t", "u") for d, v in (("LOOP1", "b"), ("MUN", "a"))]
    e = R.weighed(claims(spark, *rows), datasets(spark), "2026-01-01").withColumn("mass", F.lit(0.3)).withColumn("authority", F.lit(None).cast("int"))
    d = R.decided(e)
    assert {r.value for r in d.collect()} == {"a"} and all(r.escalated for r in d.collect())
    q = R.queue(d, e).collect()
    assert {r.batch for r in q} == {2} and all(0 < r.priority < 1 for r in q)
