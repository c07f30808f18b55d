"""Reports, lookups and joins over the published tables, and running streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terraweave.functions.ground import add_place, first_rows
from terraweave.operators import grid
from terraweave.operators import overlay as O
from terraweave.operators import records as S
from terraweave.operators.profile import long_values
from terraweave.queries.feeds import _CELLS, _cells
from terraweave.queries.ground import _HOUSES, GROUND
from terraweave.session import durable, scratch_path, table
from terraweave.streaming import feeds


def _ground(spark, sf_dir, *datasets):
    f = table(spark, sf_dir, "source_feature")
    return O.ground_polygons(f.where(F.col("dataset_id").isin(*datasets)) if datasets else f)


def a21_values(spark, sf_dir):
    """What the values of every attribute of every dataset look like."""
    v = S.value_patterns(long_values(table(spark, sf_dir, "source_feature"), ["dataset_id"]), ["dataset_id", "attribute"])
    return v.select("dataset_id", "attribute", "n", *[F.round(c, 6).alias(c) for c in ("mean_length", "length_deviation", *S.PATTERNS)])


def x5_heights(spark, sf_dir):
    """The height of every drone building and where it comes from."""
    p = F.col("properties")
    h = S.resolved_height(p["height_m"].try_cast("double"), p["floors"].try_cast("double"))
    return _ground(spark, sf_dir, "DRONE_BLDG").select("fid", F.round(h["height"], 3).alias("height"), h["source"].alias("source"))


def a18_totals(spark, sf_dir):
    """Buildings, tallest and volume by where heights come from."""
    p = F.col("properties")
    h = S.resolved_height(p["height_m"].try_cast("double"), p["floors"].try_cast("double"))
    b = _ground(spark, sf_dir, "DRONE_BLDG").select(h.alias("h"), O.polygon_area(F.col("geom")).alias("area"))
    return b.groupBy(F.col("h.source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("h.height"), 3).alias("tallest"), F.round(F.sum(F.col("h.height") * F.col("area")), 0).alias("volume"))


def qc_reasons(spark, sf_dir):
    """Why machine footprints are turned down, by the first reason that holds."""
    b = _ground(spark, sf_dir, "ML_FOOT").withColumn("area", O.polygon_area(F.col("geom")))
    from terraweave.functions import rings as R

    ring = F.get("geom.rings", F.lit(0))
    near = R.shifted(ring, -F.get(ring, F.lit(0))["x"], -F.get(ring, F.lit(0))["y"])
    confidence = F.col("properties")["confidence"].try_cast("double")
    tests = {"confidence": confidence < 0.65, "empty": F.col("area") == 0, "small": F.col("area") < 8, "large": F.col("area") > 60000, "thin": R.compactness(near) < 0.16, "vertices": F.size(ring) > 400}
    return b.groupBy(F.coalesce(S.first_failure(tests), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 1).alias("area"))


_WINDOW = (505700.0, 1220100.0, 506100.0, 1220500.0)


def s15_clip(spark, sf_dir):
    """Features that meet a window, and how many were scanned and kept."""
    kept, n = S.clipped_counts(_ground(spark, sf_dir).select("fid", "dataset_id", "x1", "y1", "x2", "y2"), *_WINDOW)
    return kept.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).withColumn("scanned", F.lit(n["scanned"])).withColumn("kept", F.lit(n["kept"]))


def k9_groups(spark, sf_dir):
    """The largest places by the first name that a feature states: a report of 40."""
    p = F.col("properties")
    return S.top_groups(table(spark, sf_dir, "source_feature").select(p["locality"].alias("a"), p["Village"].alias("b"), p["village"].alias("c")), ["a", "b", "c"])


def j17_shared(spark, sf_dir):
    """How often records of two datasets state one value that each of them states once."""
    v = long_values(table(spark, sf_dir, "source_feature"), ["dataset_id", "id"])
    return S.shared_values(v, ["id", "attribute"], "dataset_id").groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("n"))


def j18_catalogue(spark, sf_dir):
    """The datasets that contribute claims to entities, with what the catalogue says of them."""
    c = table(spark, sf_dir, "source_claim").where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("dataset_id")), ",").alias("joined"))
    n = c.select(F.explode(F.split("joined", ",")).alias("dataset_id")).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("entities"))
    return n.join(table(spark, sf_dir, "source_dataset").select("dataset_id", "title", "authority_code", "licence"), "dataset_id", "left")


def z9_catalogue(spark, sf_dir):
    """Every dataset with its features and claims, and how far it is integrated."""
    d = table(spark, sf_dir, "source_dataset").select("dataset_id", "source_type")
    f = table(spark, sf_dir, "source_feature").groupBy("dataset_id").agg(F.countDistinct("source_feature_id").alias("features"))
    c = table(spark, sf_dir, "source_claim").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("claims"), F.count("entity_id").alias("settled"))
    out = d.join(f, "dataset_id", "left").join(c, "dataset_id", "left")
    status = F.when(F.coalesce("settled", F.lit(0)) > 0, "fused").when(F.coalesce("claims", F.lit(0)) > 0, "claimed").when(F.coalesce("features", F.lit(0)) > 0, "loaded").otherwise("declared")
    return out.select("dataset_id", "source_type", F.coalesce("features", F.lit(0)).alias("features"), F.coalesce("claims", F.lit(0)).alias("claims"), status.alias("status"))


def _nodes(spark, sf_dir):
    return _points(spark, sf_dir, "UTIL_NODE").select(F.col("id").alias("fid"), "x", "y")


def _points(spark, sf_dir, dataset, *properties):
    """The placed points of a dataset, each feature once, with some of its properties."""
    f = table(spark, sf_dir, "source_feature").where(F.col("dataset_id") == dataset)
    told = [F.col("properties")[p].alias(p) for p in properties]
    placed = add_place(f.select("dataset_id", "source_feature_id", "id", "geom_metric", "geom", *told), "geom_metric", "geom", "x", "y")
    # Stored before it is filtered: a filter would be pushed into the projection and repeat it.
    return durable(first_rows(placed, ["dataset_id", "source_feature_id"], "id", ["x", "y", *properties])).where("x IS NOT NULL")


def j10_nearest(spark, sf_dir):
    """The nearest building within 30 metres of each utility node, by centres of envelopes."""
    b = _ground(spark, sf_dir, "DRONE_BLDG", "CITY_BLDG", "ML_FOOT").select("fid", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    n = grid.nearest_join(_nodes(spark, sf_dir), b, 30.0)
    return n.select("l_fid", "r_fid", F.round("distance", 2).alias("distance"))


def a12_network(spark, sf_dir):
    """Points, hull in hectares and mean stated deviation of the control network."""
    placed = _points(spark, sf_dir, "CTRL_PT", "sigma_m").withColumn("sigma", F.col("sigma_m").try_cast("double"))
    own = placed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sigma") <= 0.10).alias("usable"), F.round(F.avg("sigma"), 6).alias("mean_sigma"))
    # One row against one row.
    return own.join(F.broadcast(S.hull_area(placed))).select("n", "usable", "mean_sigma", F.round(F.col("area") / 10000, 2).alias("hull_ha"))


def s18_villages(spark, sf_dir):
    """The place of every village: the mean of the vertices of its parcels, and its cell of a tenth of a kilometre."""
    p = _ground(spark, sf_dir, "SVR_CADASTRE").select(F.col("properties")["lgd_village_code"].alias("village"), F.explode(F.get("geom.rings", F.lit(0))).alias("v")).where("village IS NOT NULL")
    m = p.groupBy("village").agg(F.avg("v.x").alias("x"), F.avg("v.y").alias("y"), F.count(F.lit(1)).alias("vertices"))
    return m.select("village", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "vertices", F.floor(F.col("x") / 100).alias("u"), F.floor(F.col("y") / 100).alias("v"))


def u6_lookup(spark, sf_dir):
    """The record that stands for each number and village: of the cadastre, else of the roll."""
    from terraweave.functions import values as V

    f = table(spark, sf_dir, "source_feature").where(F.col("dataset_id").isin("SVR_CADASTRE", "PATTA_ROLL"))
    p = F.col("properties")
    rows = f.select("id", (F.col("dataset_id") != "SVR_CADASTRE").cast("int").alias("order"), V.survey_normal_form(V.squeezed(F.coalesce(p["survey_number"], p["survey_no"]))).alias("number"), F.nullif(F.trim(p["lgd_village_code"]), F.lit("")).alias("village"))
    return rows.dropna().groupBy("village", "number").agg(F.min(F.struct("order", "id")).alias("b"), F.count(F.lit(1)).alias("n")).select("village", "number", F.col("b.id").alias("id"), "n")


def z26_extents(spark, sf_dir):
    """Width, height and area of the ground every dataset covers."""
    g = _ground(spark, sf_dir).groupBy("dataset_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return g.select("dataset_id", F.round(w, 2).alias("width"), F.round(h, 2).alias("height"), F.round(w * h / 1e6, 4).alias("km2"))


def r1_filled(spark, sf_dir):
    """A surface with holes, filled from the cells around."""
    holed = _cells(spark, sf_dir).withColumn("z", F.when((F.col("r") * 7 + F.col("c")) % 11 != 0, F.col("z")))
    return S.filled(holed).select("r", "c", F.round("z", 6).alias("z"))


_RAMP = [(0.0, 0, 0, 128), (2.0, 0, 128, 255), (4.0, 128, 255, 128), (8.0, 255, 255, 0), (12.0, 255, 0, 0)]


def r8_ramp(spark, sf_dir):
    """Values read back from the colours of a ramp, where the colour can be trusted."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "CAST(event_id * 37 % 256 AS DOUBLE) AS red", "CAST(event_id * 59 % 256 AS DOUBLE) AS green", "CAST(event_id * 83 % 256 AS DOUBLE) AS blue")
    return S.ramp_values(e, _RAMP, 60.0).select("event_id", "value", F.round("distance", 6).alias("distance"))


def r5_offsets(spark, sf_dir):
    """The shift of every tile of a surface against itself drawn three rows and five columns on."""
    c = _cells(spark, sf_dir).select("r", "c", F.pmod(F.xxhash64("r", "c"), F.lit(1000)).cast("double").alias("z0"))
    moved = c.select((F.col("r") + 3).alias("r"), (F.col("c") + 5).alias("c"), F.col("z0").alias("z1"))
    return S.tile_offsets(c.join(moved, ["r", "c"], "left")).select("tile_r", "tile_c", "rows", "columns")


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


def st1_windows(spark, sf_dir):
    """Daily counts of events by a running stream that reads what there is and stops."""
    name = f"w{uuid.uuid4().hex}"
    run = feeds.windowed_counts(_event_stream(spark, sf_dir)).writeStream.format("memory").queryName(name).outputMode("complete")
    run.option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def st2_latest(spark, sf_dir):
    """The last event of every user, kept by a running stream in a merged table."""
    path = scratch_path(spark, "merged")
    sink = feeds.merge_into(path, ["user_id"], "event_id")
    seen = []

    def write(batch, number):
        sink(batch, number)
        seen.append(number)

    stream = _event_stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/v={max(seen)}").select("user_id", "event_id", "event_type")


def k2_published(spark, sf_dir):
    """Rows of the published parts: all parcels and buildings, and a report of the 100 largest parcels."""
    g = durable(_ground(spark, sf_dir).select("fid", "dataset_id", "feature_class", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("size")))
    parts = {"parcels": g.where("feature_class = 'parcel'"), "buildings": g.where("feature_class = 'building'"), "largest": g.where("feature_class = 'parcel'")}
    folder, counts = S.publish(spark, parts, {"largest": ([F.desc("size"), "fid"], 100)})
    back = [spark.read.json(f"{folder}/{n}").agg(F.lit(n).alias("part"), F.round(F.sum("size"), 0).alias("size")) for n in parts]
    return counts.join(back[0].unionByName(back[1]).unionByName(back[2]), "part")


def k6_sequence(spark, sf_dir):
    """Drone buildings written as CityJSON text sequences and read again: vertices and faces of each."""
    from terraweave.sources.writers import write_city_sequence

    p = F.col("properties")
    b = _ground(spark, sf_dir, "DRONE_BLDG").select("fid", "geom", S.resolved_height(p["height_m"].try_cast("double"), p["floors"].try_cast("double"))["height"].alias("height"))
    path = scratch_path(spark, "city")
    write_city_sequence(b, path, 32644)
    lines = spark.read.text(f"{path}/features").select(F.from_json("value", "id string, vertices array<array<bigint>>, CityObjects map<string,struct<geometry:array<struct<boundaries:array<array<array<array<bigint>>>>>>>>").alias("f"))
    shell = F.get(F.get(F.element_at("f.CityObjects", F.col("f.id"))["geometry"], F.lit(0))["boundaries"], F.lit(0))
    return lines.select(F.col("f.id").cast("bigint").alias("fid"), F.size("f.vertices").cast("bigint").alias("vertices"), F.size(shell).cast("bigint").alias("faces"), F.round(F.array_max(F.transform("f.vertices", lambda v: F.get(v, F.lit(2)))) / 1000, 3).alias("height"))


def k7_sketches(spark, sf_dir):
    """Field sketches of cadastral parcels as XML, and how long their drawings are."""
    from terraweave.sources.writers import sketch_xml, svg_sketch

    ring = F.get("geom.rings", F.lit(0))
    p = _ground(spark, sf_dir, "SVR_CADASTRE").select("fid", sketch_xml(F.col("fid"), O.field_sketch(ring)).alias("xml"), svg_sketch(ring).alias("svg"))
    return p.select("fid", F.regexp_count("xml", F.lit("<station ")).cast("bigint").alias("stations"), F.regexp_count("svg", F.lit(",")).cast("bigint").alias("points"))


QUERIES = {
    "k6_sequence": k6_sequence, "k7_sketches": k7_sketches,
    "a21_values": a21_values, "x5_heights": x5_heights, "a18_totals": a18_totals, "qc_reasons": qc_reasons, "s15_clip": s15_clip, "k9_groups": k9_groups, "j17_shared": j17_shared, "j18_catalogue": j18_catalogue, "z9_catalogue": z9_catalogue,
    "j10_nearest": j10_nearest, "a12_network": a12_network, "s18_villages": s18_villages, "u6_lookup": u6_lookup, "z26_extents": z26_extents, "r1_filled": r1_filled, "r8_ramp": r8_ramp, "r5_offsets": r5_offsets, "st1_windows": st1_windows,
    "st2_latest": st2_latest, "k2_published": k2_published,
}

_HEIGHTS = """, h AS (SELECT fid, area, CASE WHEN s BETWEEN 2.2 AND 300 THEN s WHEN f > 0 AND f * 3 BETWEEN 2.2 AND 300 THEN f * 3 END AS height, CASE WHEN s BETWEEN 2.2 AND 300 THEN 'stated' WHEN f > 0 AND f * 3 BETWEEN 2.2 AND 300 THEN 'floors' ELSE 'none' END AS source
  FROM (SELECT fid, area, try_cast(properties['height_m'] AS DOUBLE) AS s, try_cast(properties['floors'] AS DOUBLE) AS f FROM ground JOIN sizes USING (fid) WHERE dataset_id = 'DRONE_BLDG'))"""
_VALUES = "v AS (SELECT dataset_id, id, kv.key AS attribute, kv.value AS value FROM (SELECT dataset_id, id, unnest(map_entries(properties)) AS kv FROM source_feature) WHERE trim(kv.value) <> '')"
_X1, _Y1, _X2, _Y2 = _WINDOW
ORACLES = {
    "a21_values": f"WITH {_VALUES} SELECT dataset_id, attribute, count(*) AS n, round(avg(length(value)), 6) AS mean_length, round(stddev_pop(length(value)), 6) AS length_deviation, " + ", ".join(f"round(avg(regexp_matches(value, '{p.replace(chr(39), chr(39) * 2)}')::INT), 6) AS {n}" for n, p in S.PATTERNS.items()) + " FROM v GROUP BY 1, 2",
    "k6_sequence": f"WITH {GROUND}{_HEIGHTS} SELECT fid, 2 * (len(rings[1]) - 1) AS vertices, len(rings[1]) + 1 AS faces, round(height, 3) AS height FROM h JOIN ground USING (fid) WHERE height > 0",
    "k7_sketches": f"WITH {GROUND} SELECT fid, len(rings[1]) - 1 AS stations, len(rings[1]) AS points FROM ground WHERE dataset_id = 'SVR_CADASTRE'",
    "x5_heights": f"WITH {GROUND}{_HEIGHTS} SELECT fid, round(height, 3) AS height, source FROM h",
    "a18_totals": f"WITH {GROUND}{_HEIGHTS} SELECT source, count(*) AS n, round(max(height), 3) AS tallest, round(sum(height * area), 0) AS volume FROM h GROUP BY 1",
    "qc_reasons": f"""WITH {GROUND} SELECT CASE WHEN try_cast(properties['confidence'] AS DOUBLE) < 0.65 THEN 'confidence' WHEN area = 0 THEN 'empty' WHEN area < 8 THEN 'small' WHEN area > 60000 THEN 'large' WHEN 4 * pi() * outer_area / pow(perimeter, 2) < 0.16 THEN 'thin' WHEN len(rings[1]) > 400 THEN 'vertices' ELSE 'kept' END AS reason,
  count(*) AS n, round(sum(area), 1) AS area FROM ground JOIN sizes USING (fid) WHERE dataset_id = 'ML_FOOT' GROUP BY 1""",
    "s15_clip": f"WITH {GROUND}, k AS (SELECT * FROM ground WHERE x1 <= {_X2} AND x2 >= {_X1} AND y1 <= {_Y2} AND y2 >= {_Y1}) SELECT dataset_id, count(*) AS n, (SELECT count(*) FROM ground) AS scanned, (SELECT count(*) FROM k) AS kept FROM k GROUP BY 1",
    "k9_groups": "WITH k AS (SELECT coalesce(nullif(trim(properties['locality']), ''), nullif(trim(properties['Village']), ''), nullif(trim(properties['village']), '')) AS key FROM source_feature) SELECT key, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, key LIMIT 40",
    "j17_shared": f"WITH {_VALUES}, o AS (SELECT dataset_id, value FROM v GROUP BY 1, 2 HAVING count(*) = 1) SELECT a.dataset_id AS source_a, b.dataset_id AS source_b, count(*) AS n FROM o AS a JOIN o AS b ON a.value = b.value AND a.dataset_id < b.dataset_id GROUP BY 1, 2",
    "j18_catalogue": "SELECT c.dataset_id, count(DISTINCT entity_id) AS entities, any_value(title) AS title, any_value(authority_code) AS authority_code, any_value(licence) AS licence FROM source_claim AS c LEFT JOIN source_dataset AS d ON d.dataset_id = c.dataset_id WHERE entity_id IS NOT NULL AND c.dataset_id IS NOT NULL GROUP BY 1",
    "z9_catalogue": """WITH f AS (SELECT dataset_id, count(DISTINCT source_feature_id) AS n FROM source_feature GROUP BY 1), c AS (SELECT dataset_id, count(*) AS n, count(entity_id) AS s FROM source_claim GROUP BY 1)
SELECT d.dataset_id, source_type, coalesce(f.n, 0) AS features, coalesce(c.n, 0) AS claims, CASE WHEN coalesce(s, 0) > 0 THEN 'fused' WHEN coalesce(c.n, 0) > 0 THEN 'claimed' WHEN coalesce(f.n, 0) > 0 THEN 'loaded' ELSE 'declared' END AS status FROM source_dataset AS d LEFT JOIN f ON f.dataset_id = d.dataset_id LEFT JOIN c ON c.dataset_id = d.dataset_id""",
    "s18_villages": f"WITH {GROUND}, v AS (SELECT properties['lgd_village_code'] AS village, unnest(rings[1]) AS p FROM ground WHERE dataset_id = 'SVR_CADASTRE' AND properties['lgd_village_code'] IS NOT NULL), m AS (SELECT village, avg(p.x) AS x, avg(p.y) AS y, count(*) AS vertices FROM v GROUP BY 1) SELECT village, round(x, 2) AS x, round(y, 2) AS y, vertices, floor(x / 100)::BIGINT AS u, floor(y / 100)::BIGINT AS v FROM m",
    "z26_extents": f"WITH {GROUND}, b AS (SELECT dataset_id, max(x2) - min(x1) AS w, max(y2) - min(y1) AS h FROM ground GROUP BY 1) SELECT dataset_id, round(w, 2) AS width, round(h, 2) AS height, round(w * h / 1e6, 4) AS km2 FROM b",
    "r1_filled": f"""WITH t AS ({_CELLS}), n AS (SELECT r, c, CASE WHEN (r * 7 + c) % 11 <> 0 THEN z END AS z FROM t), a AS (SELECT *, sum(coalesce(z, 0)) OVER w AS s, sum((z IS NOT NULL)::INT) OVER w AS k FROM n WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT *, sum(s) OVER w AS ss, sum(k) OVER w AS kk FROM a WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT r, c, round(coalesce(z, ss / kk), 6) AS z FROM b""",
    "r8_ramp": "WITH e AS (SELECT event_id, event_id * 37 % 256 AS red, event_id * 59 % 256 AS green, event_id * 83 % 256 AS blue FROM events), p(v, r, g, b) AS (VALUES " + ", ".join(f"({v}::DOUBLE, {r}, {g}, {b})" for v, r, g, b in _RAMP) + "), d AS (SELECT event_id, v, sqrt(pow(red - r, 2) + pow(green - g, 2) + pow(blue - b, 2)) AS d FROM e, p), m AS (SELECT event_id, arg_min(v, struct_pack(d := d, v := v)) AS v, min(d) AS d FROM d GROUP BY 1) SELECT event_id, CASE WHEN d <= 60 THEN v END AS value, round(d, 6) AS distance FROM m",
    "st1_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "st2_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "k2_published": f"""WITH {GROUND}, g AS (SELECT fid, feature_class, (x2 - x1) * (y2 - y1) AS size FROM ground), l AS (SELECT * FROM g WHERE feature_class = 'parcel' ORDER BY size DESC, fid LIMIT 100)
SELECT feature_class || 's' AS part, count(*) AS rows, round(sum(size), 0) AS size FROM g WHERE feature_class IN ('parcel', 'building') GROUP BY 1 UNION ALL SELECT 'largest', count(*), round(sum(size), 0) FROM l""",
}
