from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from terraweave.llm import matching as M

GEOM = "struct<kind:string,rings:array<array<struct<x:double,y:double>>>>"
SCHEMA = f"id bigint, dataset_id string, source_feature_id string, feature_class string, geom {GEOM}, geom_metric {GEOM}, properties map<string,string>, run_id string"


def box(x, y, w, h):
    return ("Polygon", [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]])


def village(seed=1, n=150):
    """Parcels in a grid as two sources draw them and a roll without places, and the true pairs."""
    rng = random.Random(seed)
    rows, truth, k = [], set(), 0
    for i in range(n):
        x, y = 505000 + (i % 15) * 14.0, 1220000 + (i // 15) * 62.0
        w, h = 9 + rng.random() * 4, 50 + rng.random() * 10
        ids = {}
        for ds, dx, dy, key in (("A", 0, 0, "survey_number"), ("B", 5.5, -4.0, "Survey_Number"), ("R", None, None, "survey_no")):
            if rng.random() < 0.15:
                continue
            k += 1
            ids[ds] = k
            place = None if dx is None else box(x + dx + rng.gauss(0, 0.4), y + dy + rng.gauss(0, 0.4), w, h)
            said = {key: f"{100 + i}/{1 + i % 3}", "extent": f"{w * h:.2f}", "lgd_village_code": "600001", "village": "Koravamul"}
            if rng.random() < 0.05:
                said.pop(key)
            rows.append((k, ds, f"{ds}{i}", "parcel", None, place, said, f"{ds}-0"))
        for a in ids:
            for b in ids:
                if a < b:
                    truth.add(tuple(sorted((ids[a], ids[b]))))
    return rows, truth


def test_finds_the_pairs_of_displaced_sources_and_a_roll(spark):
    rows, truth = village()
    features = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("x")).withColumn("ds", F.lit("x"))
    got = {(r.id_a, r.id_b): r.confidence for r in M.matched(features, ["parcel"]).collect()}
    hit = len(truth & set(got))
    assert hit / len(got) > 0.97 and hit / len(truth) > 0.85
    assert all(0.5 <= c <= 1 for c in got.values())


def test_nulls_repeats_and_empty(spark):
    rows, _ = village(2, 60)
    late = [(1000 + r[0], *r[1:]) for r in rows[:40]]
    odd = [(5000, None, None, "parcel", None, None, None, None), (5001, "A", "zz", "parcel", ("Polygon", []), ("Polygon", [[]]), {}, "A-0"), (5002, "B", "yy", "parcel", None, box(1.0, 1.0, 2.0, 2.0), {"village": ""}, None)]
    once = M.matched(spark.createDataFrame(rows, SCHEMA), ["parcel"]).select("id_a", "id_b").collect()
    more = M.matched(spark.createDataFrame(rows + late + odd, SCHEMA), ["parcel"]).select("id_a", "id_b").collect()
    assert set(map(tuple, once)) == set(map(tuple, more))
    assert M.matched(spark.createDataFrame([], SCHEMA), ["parcel"]).count() == 0


def test_mixture_separates_without_labels():
    rng = np.random.default_rng(4)
    x = np.clip(np.vstack([rng.normal(0.15, 0.1, (900, 3)), rng.normal(0.85, 0.08, (300, 3))]), 0, 1)
    m = M.Mixture.fitted(x, np.ones(len(x)))
    p = m.posterior(x)
    assert (p[:900] < 0.5).mean() > 0.98 and (p[900:] > 0.5).mean() > 0.98


def test_transitivity(spark):
    cols = "id_a bigint, id_b bigint, ds_a string, ds_b string, type string, size_a double, size_b double, rank double, s1 double, s2 double, s3 double, p double"
    rows = [(1, 2, "A", "B", "A|B", 5.0, 5.0, 0.0, 1.0, 1.0, 1.0, 0.99), (2, 3, "B", "C", "B|C", 5.0, 5.0, 0.0, 1.0, 1.0, 1.0, 0.98), (1, 4, "A", "C", "A|C", 5.0, 5.0, 0.0, 0.2, 0.2, 0.2, 0.03)]
    got = {(r.id_a, r.id_b): r.p for r in M.closed(spark.createDataFrame(rows, cols)).collect()}
    assert abs(got[1, 3] - 0.99 * 0.98) < 1e-9 and got[1, 4] == 0.03
    known = {(r.id_a, r.id_b): r.p for r in M.closed(spark.createDataFrame([*rows, (1, 3, "A", "C", "A|C", 5.0, 5.0, 0.0, 0.5, 0.5, 0.5, 0.4)], cols)).collect()}
    assert abs(known[1, 3] - 0.99 * 0.98) < 1e-9 and len(known) == 4


def test_a_contradicted_pair_lowers_the_less_sure_link(spark):
    cols = "id_a bigint, id_b bigint, ds_a string, ds_b string, type string, size_a double, size_b double, rank double, s1 double, s2 double, s3 double, p double"
    link = lambda a, b, x, y, p, za=5.0, zb=5.0: (a, b, x, y, f"{x}|{y}", za, zb, 0.0, 0.5, 0.5, 0.5, p)
    after = lambda *rows: {(r.id_a, r.id_b): r.p for r in M.closed(spark.createDataFrame(list(rows), cols)).collect()}
    # No candidate and sizes apart: neither inferred nor both links kept.
    apart = after(link(1, 2, "A", "B", 0.9, 5.0, 5.3), link(2, 3, "B", "C", 0.8, 5.3, 5.6))
    assert apart == {(1, 2): 0.9, (2, 3): 0.0}
    # Records 1 and 3 have each a surer partner in the other's dataset: 1-4 leaves 0.01 for 1-3.
    taken = after(link(1, 2, "A", "B", 0.9), link(2, 3, "B", "C", 0.8), link(1, 4, "A", "C", 0.99))
    assert taken[1, 2] == 0.9 and abs(taken[2, 3] - 0.01 / 0.9) < 1e-9 and taken[1, 4] == 0.99
    # An improbable candidate against two links, and one that the links outweigh.
    unlikely = after(link(1, 2, "A", "B", 0.7), link(2, 3, "B", "C", 0.95), link(1, 3, "A", "C", 0.1))
    assert abs(unlikely[1, 2] - 0.1 / 0.95) < 1e-9 and unlikely[2, 3] == 0.95 and unlikely[1, 3] == 0.1
    likely = after(link(1, 2, "A", "B", 0.9), link(2, 3, "B", "C", 0.95), link(1, 3, "A", "C", 0.4))
    assert likely[1, 2] == 0.9 and likely[2, 3] == 0.95 and abs(likely[1, 3] - 0.9 * 0.95) < 1e-9


def test_place_names(spark):
    names = [("koravamul", "1")] * 5 + [("koravmul", None), ("korawamul", None), ("veloshaporai", "2"), ("veloshaporai", "2"), ("veloshaporai", "2"), (None, "3"), ("zz", None)]
    got = {r.name: r.code for r in M.name_codes(spark.createDataFrame(names, "name string, code string")).collect()}
    assert got == {"koravamul": "1", "koravmul": "1", "korawamul": "1", "veloshaporai": "2"}


def test_hot_numbers_and_placeholder_places(spark):
    rows, truth = village(3, 80)
    # A roll that states one number without size for many rows, and a source that puts many parcels on one spot.
    roll = [(10_000 + k, "R", f"hot{k}", "parcel", None, None, {"survey_no": "900/1", "lgd_village_code": "600001"}, "R-0") for k in range(400)]
    spot = [(20_000 + k, "B", f"spot{k}", "parcel", None, box(505000.0, 1220000.0, 10.0, 55.0), {"Survey_Number": f"{950 + k}/1", "lgd_village_code": "600001"}, "B-0") for k in range(60)]
    one = [(30_000, "A", "one", "parcel", None, box(506000.0, 1221000.0, 9.0, 50.0), {"survey_number": "900/1", "lgd_village_code": "600001"}, "A-0")]
    rec = M.records(spark.createDataFrame(rows + roll + spot + one, SCHEMA), ["parcel"])
    assert rec.where("id >= 20000 and id < 30000 and x is not null").count() == 0
    pairs = M.number_candidates(rec)
    assert pairs.where("id_a >= 10000 and id_a < 20000 or id_b >= 10000 and id_b < 20000").select("id_a", "id_b").collect() == [(30_000, 10_000)]
    got = {(r.id_a, r.id_b) for r in M.matched(spark.createDataFrame(rows + roll + spot + one, SCHEMA), ["parcel"]).collect()}
    small = {p for p in got if max(p) < 10_000}
    assert len(truth & small) / len(truth) > 0.85 and len(truth & small) / len(small) > 0.95


def test_parameters_follow_from_corrected_posteriors(spark):
    rng = random.Random(8)
    cols = "id_a bigint, id_b bigint, ds_a string, ds_b string, kind string, type string, size_a double, size_b double, rank double, s1 double, s2 double, s3 double"
    rows = []
    for k in range(300):
        good = k % 3 == 0
        s = [min(1.0, max(0.0, rng.gauss(0.85 if good else 0.2, 0.08))) for _ in range(3)]
        rows.append((k, 1000 + k, "A", "B", "parcel", "A|B", 5.0, 5.0, 0.0, *s))
    vectors = spark.createDataFrame(rows, cols)
    lattice = M.lattice_counts(vectors)
    first = M.first_fit(lattice)
    pairs = M.with_posterior(vectors, first, 1)
    assert pairs.where("p > 0.5").count() == 100
    still = M.next_fit(lattice, first, pairs.limit(0).withColumn("before", F.col("p"))).first()
    moved = M.next_fit(lattice, first, pairs.where("id_a < 30").withColumn("before", F.col("p")).withColumn("p", F.lit(0.0))).first()
    assert abs(still.weight[1] - 1 / 3) < 0.01 and abs(moved.weight[1] - 90 / 300) < 0.01


def centred(x, y, w, h):
    return box(x - w / 2, y - h / 2, w, h)


def test_records_of_a_shared_place_have_all_candidates(spark):
    rng = random.Random(6)
    rows, known = [], {}

    def add(k, ds, kind, x, y):
        w = rng.uniform(6, 12)
        rows.append((k, ds, f"{ds}{k}", kind, None, centred(x, y, w, 10.0), {}, f"{ds}-0"))
        known[k] = (ds, kind, x, y, np.log(w * 10.0))

    # Two sources share a place each, on both sides of a border of cells; single records of three sources lie around them.
    for kind, base in (("building", 0), ("parcel", 1000)):
        for k in range(25):
            add(base + k, "B", kind, 505199.0, 1220039.0)
        for k in range(25, 55):
            add(base + k, "C", kind, 505204.0, 1220043.0)
        for k in range(55, 100):
            add(base + k, "ABD"[k % 3], kind, 505200.0 + rng.uniform(-40, 40), 1220040.0 + rng.uniform(-40, 40))
    rec = M.records(spark.createDataFrame(rows, SCHEMA), ["parcel", "building"])
    got = [(r.id_a, r.id_b) for r in M.place_candidates(rec).select("id_a", "id_b").collect()]
    wanted = {
        (a, b)
        for a, (da, ka, xa, ya, sa) in known.items()
        for b, (db, kb, xb, yb, sb) in known.items()
        if da < db and ka == kb and np.hypot(xb - xa, yb - ya) <= M.REACH[ka] and abs(sa - sb) <= M.SIZE_LIMIT[ka]
    }
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 1500
    vectors = M.similarity_vectors(rec).select("id_a", "id_b").collect()
    assert len(vectors) == len(wanted) and set(map(tuple, vectors)) == wanted


def test_a_pair_is_found_whatever_the_number_of_records_at_its_place(spark):
    rows, _ = village(3, 80)
    # Only the first record of the place has the size of the parcel; neither states a number.
    one = [(30_000, "A", "one", "parcel", None, centred(506000.0, 1221000.0, 10.0, 55.0), {"lgd_village_code": "600001"}, "A-0")]
    spot = [(20_000 + k, "B", f"spot{k}", "parcel", None, centred(506005.5, 1220996.0, 10.0 * 1.5**k, 55.0), {"lgd_village_code": "600001"}, "B-0") for k in range(21)]
    for n in (20, 21):
        got = {(r.id_a, r.id_b) for r in M.matched(spark.createDataFrame(rows + spot[:n] + one, SCHEMA), ["parcel"]).collect()}
        assert (20_000, 30_000) in got


def test_a_shared_place_is_no_hindrance_to_the_same_number(spark):
    rows, _ = village(3, 80)
    # The roll's number and place-holding parcels of B meet A's parcels far from the shared place and 20 m beside it.
    numbers = {"lgd_village_code": "600001"}
    spot = [(20_000 + k, "B", f"spot{k}", "parcel", None, centred(506000.0, 1221000.0, 10.0, 55.0), {"Survey_Number": f"{950 + k}/1", **numbers}, "B-0") for k in range(30)]
    there = [(30_000 + k, "A", f"t{k}", "parcel", None, centred(506000.0 + (20 if k < 3 else 300 + 20 * k), 1221000.0, 10.0, 55.0), {"survey_number": f"{950 + k}/1", **numbers}, "A-0") for k in range(6)]
    got = {(r.id_a, r.id_b) for r in M.matched(spark.createDataFrame(rows + spot + there, SCHEMA), ["parcel"]).collect()}
    assert {(20_000 + k, 30_000 + k) for k in range(6)} <= got
