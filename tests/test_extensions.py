from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terraweave import registry as X
from terraweave.operators import serving as S
from terraweave.operators.resolution import fused_geometry


def test_registries(spark, tmp_path):
    X.LABELLING_FUNCTIONS.add("near")(lambda: F.when(F.col("d") < 1, 1))
    X.LABELLING_FUNCTIONS.add("far")(lambda: F.when(F.col("d") > 5, 0))
    X.LABELLING_FUNCTIONS.add("odd")(lambda: F.when(F.col("d") == 7, 1))
    X.RULES.add("negative")(lambda: F.col("d") < 0)
    X.COMPARATORS.add("same")(lambda a, b: (a == b).cast("double"))
    X.CONNECTORS.add(".pairs")(lambda s, path, ds: s.read.text(path).select(F.lit(ds).alias("dataset_id"), F.col("value").alias("fid")))
    try:
        df = spark.createDataFrame([(0.5,), (3.0,), (6.0,), (7.0,), (-1.0,), (None,)], "d double")
        assert [r.label for r in X.labelled(df).collect()] == [1, -1, 0, -1, 1, -1]
        assert [r.broken for r in X.broken_rules(df).collect()] == [[], [], [], [], ["negative"], []]
        assert df.select(X.compared(F.col("d"), F.lit(3.0), "same")).collect()[1][0] == 1.0
        path = tmp_path / "x.pairs"
        path.write_text("a\nb\n")
        assert X.read(spark, str(path), "D").count() == 2
        with pytest.raises(ValueError, match="there already"):
            X.RULES.add("negative")(lambda: F.lit(True))
        with pytest.raises(KeyError, match="known: near, far, odd"):
            X.LABELLING_FUNCTIONS["none"]
    finally:
        for registry, names in ((X.LABELLING_FUNCTIONS, ("near", "far", "odd")), (X.RULES, ("negative",)), (X.COMPARATORS, ("same",)), (X.CONNECTORS, (".pairs",))):
            for name in names:
                registry.discard(name)
    assert X.labelled(df).columns == ["d", "label"]


def test_item_filters(spark):
    rows = [(1, "d1", 0.95, "A", "Ward 12", "c1", "437/2", 0.0, 0.0, 1.0, 1.0, "owner"), (2, "d1", 0.5, "D", "Ward 3", "c2", "9", 5.0, 5.0, 6.0, 6.0, None), (3, "d2", None, None, None, None, None, 0.0, 0.0, 9.0, 9.0, "x")]
    r = spark.createDataFrame(rows, "fid int, district string, confidence double, grade string, ward string, code string, number string, x1 double, y1 double, x2 double, y2 double, owner_name string")
    changes = spark.createDataFrame([(2, "extension"), (2, "extension"), (1, "none")], "fid int, change string")
    got = lambda **kw: sorted(x.fid for x in S.items(r, **kw).collect())
    assert got() == [1, 2, 3] and got(districts=["d1"]) == [1, 2] and got(least_confidence=0.6) == [1] and got(grades=["D", "E"]) == [2] and got(ward="12") == [1] and got(code="c2") == [2]
    assert got(number="437/2") == [1] and got(changes=changes, change="extension") == [2] and got(box=(2.0, 2.0, 5.0, 5.0)) == [2, 3] and got(districts=["d1"], box=(0.0, 0.0, 2.0, 2.0)) == [1]
    assert [x.owner_name for x in S.items(r, private=["owner_name"]).orderBy("fid").collect()] == ["[redacted]", None, "[redacted]"]


def test_fused_geometry(spark):
    def box(x, y, w):
        return ("Polygon", [[(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]])

    rows = [("e", "A", box(0.0, 0.0, 10.0), 0.5, 0.1), ("e", "B", box(0.2, 0.0, 10.0), 0.4, 0.1), ("e", "C", box(30.0, 0.0, 10.0), 0.8, 0.1), ("one", "A", box(0.0, 0.0, 4.0), 0.3, None), ("none", "A", None, 0.3, 1.0), ("flat", "A", ("Polygon", [[(0.0, 0.0)]]), 0.3, 1.0)]
    df = spark.createDataFrame(rows, "entity_id string, dataset_id string, geom struct<kind:string,rings:array<array<struct<x:double,y:double>>>>, mass double, accuracy_m double")
    got = {r.entity_id: r for r in fused_geometry(df).collect()}
    assert set(got) == {"e", "one"} and (got["e"].dataset_id, got["e"].members, got["e"].claims) == ("A", 2, 3) and got["e"].corroboration == 0.5 and abs(got["e"].spread - 30) < 1e-9
    assert got["one"].corroboration == 0.0 and fused_geometry(df.limit(0)).count() == 0
