from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from terraweave.operators import assignment as A


def test_hungarian_equals_all_permutations():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (2, 4), (4, 2), (5, 5), (3, 6)):
        for _ in range(8):
            cost = np.round(rng.random((n, m)), 2)
            found = A.hungarian(cost)
            small, large = min(n, m), max(n, m)
            c = cost if n <= m else cost.T
            best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
            assert len(found) == small and abs(sum(cost[i, j] for i, j in found) - best) < 1e-9


def test_contested_ends_and_large_components(spark, monkeypatch):
    rows = [("L1", "R1", 0.9), ("L2", "R1", 0.8), ("L2", "R2", 0.5), ("L1", "R2", 0.85), ("L3", "R3", 0.2), ("L4", "R4", 0.4)]
    pairs = spark.createDataFrame(rows, "l_fid string, r_fid string, p double")
    got = {(r.l_fid, r.r_fid): r.state for r in A.optimal_links(pairs).collect()}
    assert got == {("L1", "R2"): "accepted", ("L2", "R1"): "accepted", ("L4", "R4"): "flagged"}
    monkeypatch.setattr(A, "MOST_SIDE", 1)
    rng = random.Random(1)
    many = spark.createDataFrame([(f"l{i}", f"r{j}", round(rng.uniform(0.36, 1), 6)) for i in range(8) for j in range(8) if rng.random() < 0.6], "l_fid string, r_fid string, p double")
    got = A.optimal_links(many).collect()
    used, plain = set(), set()
    for r in sorted(many.collect(), key=lambda r: (-r.p, r.l_fid, r.r_fid)):
        if r.l_fid not in used and r.r_fid not in used:
            used |= {r.l_fid, r.r_fid}
            plain.add((r.l_fid, r.r_fid))
    assert {(r.l_fid, r.r_fid) for r in got} == plain
    assert A.optimal_links(many.limit(0)).count() == 0


def test_two_epochs_and_two_sources(spark):
    links = [(k, k, 100.0, 100.0, 0.1, 0) for k in range(40)] + [(40, 40, 100.0, 130.0, 0.1, 0), (41, 41, 100.0, 20.0, 0.1, 0), (42, 42, 100.0, 101.0, 2.0, 0), (43, 43, 100.0, 100.0, 0.0, 1), (44, 44, 50.0, 55.0, 0.0, 0)]
    l = spark.createDataFrame(links, "l_fid int, r_fid int, l_area double, r_area double, moved double, attributes int")
    left, right = spark.createDataFrame([(k, 100.0) for k in range(46)], "fid int, area double"), spark.createDataFrame([(k, 100.0) for k in [*range(45), 99]], "fid int, area double")
    epochs = {r.fid: (r.difference, r.actionable) for r in A.typed_differences(l, left, right, False).collect()}
    assert sum(a for _, a in epochs.values()) == 4 and epochs[40] == ("extension", True) and epochs[41] == ("demolition", True) and epochs[42] == ("displacement", False)
    assert epochs[43] == ("attribute_change", False) and epochs[44] == ("no_change", False) and epochs[45] == ("removed", True) and epochs[99] == ("new", True)
    sources = {r.fid: r.difference for r in A.typed_differences(l, left, right, True).collect()}
    assert "demolition" not in sources.values() and sources[45] == "source_omission" and sources[99] == "source_commission" and sources[41] == "geometric_disagreement"


def test_deltas_skip_case_blanks_and_nulls(spark):
    df = spark.createDataFrame([({"a": "X y", "b": "1", "c": None}, {"a": "xY", "b": "2", "c": "3"})], "x map<string,string>, y map<string,string>")
    assert df.select(A.attribute_deltas(F.col("x"), F.col("y"), ["a", "b", "c", "d"]).alias("d")).first().d == {"b": ("1", "2")}


def test_a_learned_score(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        good = k % 2 == 0
        rows.append((k, k, min(1.0, max(0.0, rng.gauss(0.8 if good else 0.2, 0.1))), rng.random(), int(good) if rng.random() < 0.6 else -1))
    pairs = spark.createDataFrame(rows, "l_fid int, r_fid int, iou double, noise double, label int")
    model = A.fit_matcher(pairs, ["iou", "noise"])
    model.write().save(str(tmp_path / "m"))
    again = A.PipelineModel.load(str(tmp_path / "m"))
    p = {r.l_fid: r.p for r in A.predicted(again, pairs).collect()}
    assert sum((p[k] > 0.5) == (k % 2 == 0) for k in p) / len(p) > 0.95
    effect = {r.feature: r.e for r in A.explained(model, pairs.where("l_fid % 2 = 0"), ["iou", "noise"]).groupBy("feature").agg(F.avg("effect").alias("e")).collect()}
    assert effect["iou"] > 0.3 > abs(effect["noise"])
    lost = {r.feature: r.importance for r in A.permutation_importance(model, pairs.where("label >= 0"), ["iou", "noise"]).collect()}
    assert lost["iou"] > 0.1 > abs(lost["noise"])
    assert A.fit_matcher(pairs.where("label = 1"), ["iou"]) is None
