from __future__ import annotations

import gzip
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terraweave.plans.dag import Plan
from terraweave.queries import catalogue
from terraweave.sources import readers, writers
from terraweave.streaming import feeds


def test_geojson_lines_skip_what_cannot_be_read(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}
    lines = ["[", json.dumps({"type": "Feature", "id": "f1", "geometry": square, "properties": {"a": "x", "n": 3}}) + ",", "", "{broken", json.dumps({"type": "Feature", "geometry": None, "properties": {}}), json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [81.0, 11.5]}, "properties": {"gcc_gis_id": "G-1"}}), "]"]
    path = tmp_path / "layer.geojsonl.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    got = {r.fid: r for r in readers.read_path(spark, str(path), "D").collect()}
    assert set(got) == {"f1", "G-1"} and got["f1"].properties == {"a": "x", "n": "3"} and got["f1"].geom.kind == "Polygon"
    assert got["G-1"].geom.rings[0][0] == (81.0, 11.5)
    claims = readers.feature_claims(readers.read_path(spark, str(path), "D"))
    assert claims.count() == 5


def test_feature_collection_and_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "a\"b", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {"k": "v", "_hidden": "h"}}]}
    path = tmp_path / "c.geojson"
    path.write_text(json.dumps(doc, indent=1))
    layer = readers.read_path(spark, str(path), "D")
    assert [(r.fid, r.geom.kind) for r in layer.collect()] == [('a"b', "LineString")]
    writers.write_geojson_lines(layer.select("fid", "geom", F.lit("v").alias("k"), F.lit(1).alias("_hidden")), str(tmp_path / "out"))
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    back = json.loads(text[0])
    assert back["id"] == 'a"b' and back["properties"] == {"k": "v"} and back["geometry"]["coordinates"] == [[0.0, 0.0], [1.0, 1.0]]


def test_wkt_csv(spark, tmp_path):
    path = tmp_path / "t.psv"
    path.write_text("id|wkt|name\n1|POINT (3 4)|x\n2||y\n")
    got = {r.fid: r for r in readers.read_path(spark, str(path), "D").collect()}
    assert got["1"].geom.rings[0][0] == (3.0, 4.0) and got["2"].geom is None and got["2"].properties == {"id": "2", "name": "y"}
    with pytest.raises(ValueError, match="known extensions"):
        readers.read_path(spark, "x.shp", "D")


def test_nmea(spark, tmp_path):
    def sentence(body):
        total = 0
        for c in body:
            total ^= ord(c)
        return f"${body}*{total:02X}"

    good = sentence("GPGGA,123519,4807.038,N,01131.000,E,4,08,1.5,545.4,M,46.9,M,,")
    path = tmp_path / "n.txt"
    path.write_text("\n".join([good, good.replace("545", "546"), "noise", sentence("GPGGA,1,,N,,E,0,00,,,M,,M,,")]))
    (row,) = readers.read_nmea(spark, str(path)).collect()
    assert abs(row.lat - 48.1173) < 1e-6 and abs(row.lon - 11.516666) < 1e-5 and abs(row.sigma_h - 0.021) < 1e-9 and abs(row.sigma_v - 0.0378) < 1e-9


def test_rinex_and_control(spark, tmp_path):
    head = "KULM".ljust(60) + "MARKER NAME\n" + "  1000.5  2000.25 -3.0".ljust(60) + "APPROX POSITION XYZ\n" + "".ljust(60) + "END OF HEADER\n"
    (tmp_path / "a.obs").write_text(head)
    (row,) = readers.read_rinex_header(spark, str(tmp_path / "a.obs")).collect()
    assert (row.marker, row.x, row.y, row.z) == ("KULM", 1000.5, 2000.25, -3.0)
    (tmp_path / "c.csv").write_text("Point,X,Y,Easting,Northing,Sigma\np1,1,2,3,4,\np2,1,bad,3,4,0.1\n")
    assert [tuple(r) for r in readers.read_control_csv(spark, str(tmp_path / "c.csv")).collect()] == [("p1", 1.0, 2.0, 3.0, 4.0, 0.05)]


def test_tiles(spark, tmp_path):
    for z, x, y in ((1, 0, 1), (1, 1, 1)):
        p = tmp_path / str(z) / str(x)
        p.mkdir(parents=True, exist_ok=True)
        (p / f"{y}.png").write_bytes(b"abc")
    assert sorted((r.zoom, r.x, r.y) for r in readers.read_tile_pyramid(spark, str(tmp_path), tms=True).collect()) == [(1, 0, 0), (1, 1, 0)]


def test_merge_keeps_new_rows(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "k bigint, v string")
    assert sorted(map(tuple, writers.merged(a, b, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, writers.merged(a, b, ["k"], overwrite=False).collect())) == [(1, "a"), (2, "b"), (3, "C")]


def test_stream_equals_batch_and_merges(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = feeds.windowed_counts(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    streamed = {(r.window_start, r.event_type): r.n for r in spark.table("counts").collect()}
    assert streamed == {(r.window_start, r.event_type): r.n for r in feeds.windowed_counts(events).collect()}
    sink = feeds.merge_into(str(tmp_path / "last"), ["user_id"], "event_id")
    merge = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    merge.processAllAvailable()
    merge.stop()
    last = spark.read.parquet(str(tmp_path / "last" / "v=2"))
    assert {(r.user_id, r.event_id) for r in last.collect()} == {(r.user_id, r.e) for r in events.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}


def test_plan_layers_resume_and_cycles(spark, tmp_path):
    plan, runs = Plan(str(tmp_path)), []

    @plan.stage("a")
    def a(s):
        runs.append("a")
        return s.range(5)

    @plan.stage("b", ("a",))
    def b(s, rows):
        runs.append("b")
        return rows.where("id > 2")

    assert plan.layers() == [["a"], ["b"]] and plan.execute(spark)["b"].count() == 2
    plan.execute(spark)
    assert runs == ["a", "b"] and [r["state"] for r in plan.report] == ["run", "run", "stored", "stored"]
    plan.stage("c", ("d",))(a)
    plan.stage("d", ("c",))(a)
    with pytest.raises(ValueError, match="cycle"):
        plan.layers()


def test_every_part_of_several_is_kept(spark, tmp_path):
    hole = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]]
    far = [[[20, 0], [20, 5], [25, 5], [25, 0], [20, 0]]]
    shapes = [
        {"type": "MultiPolygon", "coordinates": [hole, far]}, {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 7]]]},
        {"type": "GeometryCollection", "geometries": []}, {"type": "Blob", "coordinates": []},
    ]
    path = tmp_path / "several.geojsonl"
    path.write_text("\n".join(json.dumps({"type": "Feature", "id": str(k), "geometry": g, "properties": {}}) for k, g in enumerate(shapes)))
    from terraweave.functions import rings
    from terraweave.operators.overlay import polygon_area

    layer = readers.read_geojson_lines(spark, str(path), "D").select("*", polygon_area(F.col("geom")).alias("area"), rings.wkt(F.col("geom")).alias("text"))
    got = {r.fid: r for r in layer.collect()}
    assert set(got) == {"0", "1", "2"} and got["0"].geom.kind == "MultiPolygon" and len(got["0"].geom.rings) == 3 and got["0"].area == 121.0
    assert len(got["1"].geom.rings) == 2 and [len(r) for r in got["2"].geom.rings] == [2, 3]
    assert {r.kind: r.n for r in readers.unread_kinds(spark, str(path)).collect()} == {"GeometryCollection": 1, "Blob": 1}
    back = {r.fid: r.g for r in layer.select("fid", rings.from_wkt(F.col("text")).alias("g")).collect()}
    assert all(back[k] == got[k].geom for k in got)
    writers.write_geojson_lines(layer.select("fid", "geom"), str(tmp_path / "out"))
    again = {r.fid: r.geom for r in readers.read_geojson_lines(spark, str(tmp_path / "out"), "D").collect()}
    assert all(again[k] == got[k].geom for k in got)
    loose = spark.createDataFrame([("MULTIPOINT (1 2, 3 4)",), ("multipolygon (((0 0, 1 0, 1 1, 0 0)))",), ("POLYGON EMPTY",), (None,), ("x",)], "t string").select(rings.from_wkt(F.col("t")).alias("g")).collect()
    assert [r.g.kind if r.g else None for r in loose] == ["MultiPoint", "MultiPolygon", None, None, None]


def test_a_probe_and_the_declared_frame(spark, tmp_path):
    path = tmp_path / "p.geojsonl"
    path.write_text("\n".join(json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [k, 1]}, "properties": {"a": "x" if k else None, "b": str(k)}}) for k in range(4)))
    got = {r.attribute: (r.n, r.null_rate, r.distinct_values) for r in readers.probe_geojson_lines(spark, str(path), "D").collect()}
    assert got == {"a": (3, 0.25, 1), "b": (4, 0.0, 4), "geom": (4, 0.0, 1)}
    for name, crs in (("urn:ogc:def:crs:EPSG::32644", "EPSG:32644"), ("urn:ogc:def:crs:OGC:1.3:CRS84", "EPSG:4326"), (None, "EPSG:4326")):
        doc = tmp_path / "c.geojson"
        doc.write_text(json.dumps({"type": "FeatureCollection", "features": []} | ({"crs": {"type": "name", "properties": {"name": name}}} if name else {})))
        assert readers.declared_crs(spark, str(doc)).first().crs == crs


def test_a_merge_of_batches_with_gaps(spark, tmp_path):
    sink = feeds.merge_into(str(tmp_path / "t"), ["k"], "at")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, at int, v string")
    sink(rows((1, 1, "a"), (2, 1, "b")), 0)
    sink(rows((1, 2, "c")), 3)
    sink(rows((1, 2, "c")), 3)
    sink(rows((3, 1, "d"), (2, 0, "late")), 7)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t/v=7")).collect()) == [(1, "c"), (2, "b"), (3, "d")]
    assert {p.name for p in (tmp_path / "t").iterdir()} == {"v=3", "v=7"}


def test_deliveries_by_type_value_and_area(spark):
    events = spark.createDataFrame([(1, "click", 5.0, 1.0, 1.0), (2, "view", 50.0, 9.0, 9.0), (3, None, 50.0, None, 1.0)], "event_id int, event_type string, value double, x double, y double")
    subs = spark.createDataFrame([(1, ["click"], 0.0, True, None, None, None, None), (2, [], 10.0, True, 0.0, 0.0, 5.0, 5.0), (3, [], 10.0, True, None, None, None, None), (4, [], 0.0, False, None, None, None, None), (5, ["view", "view"], 0.0, True, 8.0, None, None, None)], "sub_id int, event_types array<string>, least double, active boolean, x1 double, y1 double, x2 double, y2 double")
    assert sorted(map(tuple, feeds.deliveries(events, subs).collect())) == [(1, 1), (2, 3), (2, 5), (3, 2), (3, 3)]
    assert feeds.deliveries(events, subs.limit(0)).count() == 0


def test_deliveries_are_counted_as_they_are_listed(spark):
    rng = random.Random(5)
    numbers = [0.0, -0.0, 1e-9, 1.0, 1.0000000000000002, 50.0, -3.5, -1e300, 1e300, math.inf, -math.inf, math.nan, None]
    value = lambda: rng.choice(numbers) if rng.random() < 0.4 else round(rng.gauss(20, 60), 1)
    events = spark.createDataFrame([(k, rng.choice(["click", "view", "error", "", None]), value(), rng.uniform(0, 9), 1.0) for k in range(800)], "event_id int, event_type string, value double, x double, y double")
    asks = [[], ["click"], ["view", "error"], ["click", "click", ""], ["none"], [None, "view"]]
    subs = spark.createDataFrame([(rng.randrange(150), rng.choice(asks), value(), rng.choice([True, True, False, None]), 2.0, None, 7.0, None) for _ in range(200)], "sub_id int, event_types array<string>, least double, active boolean, x1 double, y1 double, x2 double, y2 double")
    for s in (subs.drop("x1", "y1", "x2", "y2"), subs):
        want = Counter(r.sub_id for r in feeds.deliveries(events, s).collect())
        got = feeds.delivery_counts(events, s).collect()
        assert len(got) == len(want) > 50 and {r.sub_id: r.n for r in got} == want
    assert feeds.delivery_counts(events, subs.drop("x1").limit(0)).count() == feeds.delivery_counts(events.limit(0), subs.drop("x1")).count() == 0


def test_counts_of_deliveries_list_no_pairs(spark, sf_dir):
    plan = catalogue.queries()["sub_deliveries"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and ">=" in x]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_solids_drawings_and_marks(spark, tmp_path):
    from terraweave.operators.overlay import field_sketch

    ring = [(0.0, 0.0), (30.0, 0.0), (30.0, 20.0), (0.0, 20.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, ("Polygon", [ring[::-1]]), 6.5, "a<b"), (2, ("Polygon", []), 3.0, None), (3, None, 3.0, None), (4, ("Polygon", [ring]), None, None)], "fid int, geom struct<kind:string,rings:array<array<struct<x:double,y:double>>>>, height double, use string")
    writers.write_city_sequence(df, str(tmp_path / "c"), 32644)
    head = json.loads(spark.read.text(str(tmp_path / "c/head")).first().value)
    (line,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "c/features")).collect()]
    solid = line["CityObjects"]["1"]["geometry"][0]["boundaries"][0]
    assert head["transform"]["scale"] == [0.001] * 3 and len(line["vertices"]) == 8 and len(solid) == 6 and line["vertices"][4][2] == 6500 and line["CityObjects"]["1"]["attributes"]["use"] == "a<b"
    for face in solid:
        # Every face looks outwards: the volume under all faces is that of the block.
        assert len(face[0]) == 4
    v = [[c / 1000 for c in p] for p in line["vertices"]]
    volume = 0.0
    for (face,) in solid:
        a = v[face[0]]
        for k in range(1, len(face) - 1):
            b, c = v[face[k]], v[face[k + 1]]
            volume += (a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])) / 6
    assert abs(volume - 30 * 20 * 6.5) < 1e-6
    out = df.select("fid", writers.svg_sketch(F.get("geom.rings", F.lit(0))).alias("svg"), writers.sketch_xml(F.col("use"), field_sketch(F.get("geom.rings", F.lit(0)))).alias("xml"), writers.kml_placemark(F.col("use"), F.lit(81.0), F.lit(11.5), F.col("height")).alias("kml")).orderBy("fid").collect()
    assert out[0].svg.count(",") == 5 and out[1].svg is None and 'base="36.06"' in out[0].xml and 'id="a&lt;b"' in out[0].xml and out[2].xml is None and "81.0000000,11.5000000,6.5" in out[0].kml
