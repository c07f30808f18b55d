"""Scalar functions and small reports over the land records, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.functions import geodesy as G
from terraweave.functions import identifiers as I
from terraweave.operators import evidence as E
from terraweave.operators import linkage as L
from terraweave.plans.layers import layer
from terraweave.queries.evidence import _RESOLVED, _evidence
from terraweave.queries.ground import GROUND
from terraweave.queries.linkage import _SCORED
from terraweave.queries.measures import _RATED, _rated
from terraweave.session import durable, table
from terraweave.sources.readers import feature_claims

_DIMENSIONS = ("placement", "agreement", "topological", "completeness", "currency", "lineage")


def f15_floors(spark, sf_dir):
    """Storeys of every way they are written in the claims."""
    c = table(spark, sf_dir, "source_claim").where(F.lower("property_path").rlike("floor|storey")).select(F.trim("value_text").alias("text")).where("text <> ''").distinct()
    return c.select("text", I.floors(F.col("text")).alias("floors"))


def f22_areas(spark, sf_dir):
    """Ellipsoidal area of every lon/lat polygon as stored."""
    f = table(spark, sf_dir, "source_feature").where("lower(geom.kind) = 'polygon'")
    inside = F.forall("geom.rings", lambda r: (F.size(r) >= 4) & F.forall(r, lambda p: p["x"].between(80.9, 82.5) & p["y"].between(10.9, 12.5)))
    return f.where(inside).select("id", F.round(G.polygon_area(F.col("geom.rings")), 1).alias("area"))


def f24_extents(spark, sf_dir):
    """The stated extents of the coast survey as records print them."""
    v = table(spark, sf_dir, "source_feature").select("id", F.col("properties")["Shape_Area"].try_cast("double").alias("a")).where("a > 0")
    return v.select("id", G.extent_text(F.col("a")).alias("acres"), F.round(G.convert_area(F.col("a"), "m2", "acre"), 6).alias("acre"), F.round(G.convert_area(F.col("a"), "m2", "hectare"), 8).alias("hectare"))


def f25_frames(spark, sf_dir):
    """The metric frame of every part's place."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_partkey * 7 % 360 AS DOUBLE) - 180 + CAST(p_size AS DOUBLE) / 100 AS lon", "CAST(p_partkey * 3 % 170 AS DOUBLE) - 85 AS lat")
    return p.select("p_partkey", G.metric_frame(F.col("lon"), F.col("lat")).alias("frame"))


def f31_tiles(spark, sf_dir):
    """The map tile of every part's place at zoom 14."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "80.0 + CAST(p_partkey % 997 AS DOUBLE) / 100 AS lon", "8.0 + CAST(p_partkey % 491 AS DOUBLE) / 100 AS lat")
    t = I.tile(F.col("lon"), F.col("lat"), 14)
    return p.select("p_partkey", t["x"].cast("bigint").alias("x"), t["y"].cast("bigint").alias("y"))


def f34_entropy(spark, sf_dir):
    """Entropy of what is believed about every entity."""
    f = E.fused(_evidence(spark, sf_dir), ["entity"]).groupBy("entity").agg(F.sort_array(F.collect_list("belief")).alias("m"))
    return f.select("entity", F.round(E.entropy(F.col("m")), 5).alias("entropy"))


def w6_ranked(spark, sf_dir):
    """Every parcel's place by falling confidence, from 1, in its zone and over all."""
    from pyspark.sql import Window

    r = _rated(spark, sf_dir)
    # The place over all needs one order of all rows; within zones it is spread.
    return r.select("fid", "zone", F.row_number().over(Window.partitionBy("zone").orderBy(F.desc(F.round("confidence", 9)), "fid")).cast("bigint").alias("place"))


def w7_weakest(spark, sf_dir):
    """The three weakest dimensions of every parcel."""
    rows = F.array(*[F.struct(F.coalesce(F.col(c), F.lit(0.5)).alias("v"), F.lit(c).alias("k")) for c in _DIMENSIONS])
    return _rated(spark, sf_dir).select("fid", F.array_join(F.transform(F.slice(F.array_sort(rows), 1, 3), lambda s: s["k"]), ",").alias("weakest"))


def _pairs(spark, sf_dir):
    return L.scored_pairs(layer(spark, sf_dir, "parcels_a"), layer(spark, sf_dir, "parcels_b"))


def a24_votes(spark, sf_dir):
    """How many pairs the labelling functions label, leave and contradict each other on."""
    opinions = F.array_compact(F.array(*L.votes()))
    p = _pairs(spark, sf_dir).select(F.size(opinions).alias("n"), F.size(F.array_distinct(opinions)).alias("kinds"))
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n") > 0).alias("covered"), F.count_if(F.col("kinds") > 1).alias("conflicts"))


def z1_control(spark, sf_dir):
    """Control synthesised from matches: the 400 pairs of highest score, half a metre over it as deviation; a report by definition."""
    p = _pairs(spark, sf_dir).select("l_fid", "r_fid", "dx", "dy", F.round("score", 9).alias("score"))
    return p.orderBy(F.desc("score"), "l_fid", "r_fid").limit(400).select("l_fid", "r_fid", "dx", "dy", F.round(0.5 / F.col("score"), 6).alias("sigma"))


def z2_checks(spark, sf_dir):
    """Check points from matches of 0.85 or more, and what their errors say."""
    c = _pairs(spark, sf_dir).where(F.round("score", 9) >= 0.85).agg(F.count(F.lit(1)).alias("n"), F.avg("dx").alias("mx"), F.avg("dy").alias("my"), F.avg(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("ms"))
    bias = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))
    scatter = F.sqrt(F.greatest(F.col("ms") - bias * bias, F.lit(0.0)))
    said = F.when(F.col("n") < 20, "too few").when((bias > 2 * scatter) & (bias > 0.3), "systematic").otherwise("random")
    return c.select("n", F.round(bias, 5).alias("bias"), F.round(scatter, 5).alias("scatter"), said.alias("meaning"))


def s8_claims(spark, sf_dir):
    """Features told apart into claims: how many of each path and dataset."""
    f = table(spark, sf_dir, "source_feature").select("dataset_id", F.col("source_feature_id").alias("fid"), "geom", "properties")
    return feature_claims(f).groupBy("dataset_id", "property_path").agg(F.count(F.lit(1)).alias("n"))


def a20_datasets(spark, sf_dir):
    """Rows, features, repeats, missing geometries, kinds and vertices of every dataset."""
    f = table(spark, sf_dir, "source_feature")
    points = F.aggregate(F.transform("geom.rings", F.size), F.lit(0), lambda s, n: s + n)
    g = f.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source_feature_id").alias("features"), F.count_if(F.col("geom").isNull()).alias("no_geometry"), F.nullif(F.array_join(F.array_sort(F.collect_set("geom.kind")), ","), F.lit("")).alias("kinds"), F.round(F.avg(points), 6).alias("mean_vertices"))
    return g.select("dataset_id", "rows", "features", (F.col("rows") - F.col("features")).alias("repeats"), "no_geometry", "kinds", "mean_vertices")


QUERIES = {
    "f15_floors": f15_floors, "f22_areas": f22_areas, "f24_extents": f24_extents, "f25_frames": f25_frames, "f31_tiles": f31_tiles, "f34_entropy": f34_entropy, "w6_ranked": w6_ranked, "w7_weakest": w7_weakest,
    "a24_votes": a24_votes, "z1_control": z1_control, "z2_checks": z2_checks, "s8_claims": s8_claims, "a20_datasets": a20_datasets,
}

_E2 = "0.0066943799901413165"
_Q = "(1 - {e2}) * (sin(radians({y})) / (1 - {e2} * pow(sin(radians({y})), 2)) + atanh(sin(radians({y})) * sqrt({e2})) / sqrt({e2}))"
ORACLES = {
    "f15_floors": r"""WITH t AS (SELECT DISTINCT trim(value_text) AS text FROM source_claim WHERE regexp_matches(lower(property_path), 'floor|storey') AND trim(value_text) <> ''), u AS (SELECT text, upper(regexp_replace(text, '\s+', '', 'g')) AS f FROM t)
SELECT text, CASE WHEN regexp_full_match(f, '\d+') THEN f::BIGINT WHEN regexp_full_match(f, '(B\d*\+)?G\+?\d*') THEN coalesce(nullif(regexp_extract(f, 'G\+?(\d*)$', 1), '')::BIGINT, 0) + 1 END AS floors FROM u""",
    "f22_areas": f"""WITH g AS (SELECT id, geom.rings AS rings FROM source_feature WHERE lower(geom.kind) = 'polygon' AND len(list_filter(geom.rings, lambda r: len(r) < 4 OR len(list_filter(r, lambda p: NOT (p.x BETWEEN 80.9 AND 82.5 AND p.y BETWEEN 10.9 AND 12.5))) > 0)) = 0),
s AS (SELECT id, k, unnest(range(1, len(rings[k]))) AS i, rings[k] AS r FROM (SELECT id, rings, unnest(range(1, len(rings) + 1)) AS k FROM g)), e AS (SELECT id, k, radians(r[i + 1].x - r[i].x) * ({_Q.format(e2=_E2, y='r[i].y')} + {_Q.format(e2=_E2, y='r[i + 1].y')}) / 2 AS a FROM s),
t AS (SELECT id, k, abs(sum(a)) * 6378137.0 * 6378137.0 / 2 AS a FROM e GROUP BY 1, 2) SELECT id, round(2 * max(a) FILTER (WHERE k = 1) - sum(a), 1) AS area FROM t GROUP BY 1""",
    "f24_extents": """WITH v AS (SELECT id, try_cast(properties['Shape_Area'] AS DOUBLE) AS a FROM source_feature), w AS (SELECT *, floor(a / 4046.8564224)::BIGINT AS k, round_even((a / 4046.8564224 - floor(a / 4046.8564224)) * 100, 0)::BIGINT AS c FROM v WHERE a > 0)
SELECT id, CASE WHEN c = 100 THEN k + 1 ELSE k END || '.' || lpad((CASE WHEN c = 100 THEN 0 ELSE c END)::VARCHAR, 2, '0') || ' acre (' || format('{:,.2f}', a) || ' m²)' AS acres, round(a / 4046.8564224, 6) AS acre, round(a / 10000, 8) AS hectare FROM w""",
    "f25_frames": "SELECT p_partkey, 'EPSG:' || (floor(((p_partkey * 7 % 360)::DOUBLE - 180 + p_size::DOUBLE / 100 + 180) / 6)::INT + 1 + CASE WHEN (p_partkey * 3 % 170) - 85 >= 0 THEN 32600 ELSE 32700 END) AS frame FROM part",
    "f31_tiles": "WITH p AS (SELECT p_partkey, 80.0 + (p_partkey % 997)::DOUBLE / 100 AS lon, 8.0 + (p_partkey % 491)::DOUBLE / 100 AS lat FROM part) SELECT p_partkey, floor((lon + 180) / 360 * 16384)::BIGINT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793) / 2 * 16384)::BIGINT AS y FROM p",
    "f34_entropy": _RESOLVED + " SELECT entity, round(sum(CASE WHEN belief > 0 THEN -belief * log2(belief) ELSE 0 END), 5) AS entropy FROM fused GROUP BY 1",
    "w6_ranked": _RATED + " SELECT fid, zone, row_number() OVER (PARTITION BY zone ORDER BY round(confidence, 9) DESC, fid) AS place FROM rated",
    "w7_weakest": _RATED + " SELECT fid, array_to_string(list_transform(list_sort([" + ", ".join(f"struct_pack(v := coalesce({c}, 0.5), k := '{c}')" for c in _DIMENSIONS) + "])[1:3], lambda s: s.k), ',') AS weakest FROM rated",
    "a24_votes": _SCORED + " SELECT count(*) AS pairs, count_if(yes OR nope) AS covered, count_if(yes AND nope) AS conflicts FROM scored",
    "z1_control": _SCORED + " SELECT l_fid, r_fid, dx, dy, round(0.5 / round(score, 9), 6) AS sigma FROM scored ORDER BY round(score, 9) DESC, l_fid, r_fid LIMIT 400",
    "z2_checks": _SCORED + """, c AS (SELECT count(*) AS n, sqrt(pow(avg(dx), 2) + pow(avg(dy), 2)) AS b, avg(dx * dx + dy * dy) AS ms FROM scored WHERE round(score, 9) >= 0.85)
SELECT n, round(b, 5) AS bias, round(sqrt(greatest(ms - b * b, 0)), 5) AS scatter, CASE WHEN n < 20 THEN 'too few' WHEN b > 2 * sqrt(greatest(ms - b * b, 0)) AND b > 0.3 THEN 'systematic' ELSE 'random' END AS meaning FROM c""",
    "s8_claims": "SELECT dataset_id, 'geometry' AS property_path, count(*) AS n FROM source_feature WHERE geom IS NOT NULL GROUP BY 1 UNION ALL SELECT dataset_id, kv.key, count(*) FROM (SELECT dataset_id, unnest(map_entries(properties)) AS kv FROM source_feature) WHERE trim(kv.value) <> '' GROUP BY 1, 2",
    "a20_datasets": """WITH f AS (SELECT dataset_id, source_feature_id, geom, list_sum(list_transform(geom.rings, lambda r: len(r))) AS n FROM source_feature)
SELECT dataset_id, count(*) AS "rows", count(DISTINCT source_feature_id) AS features, count(*) - count(DISTINCT source_feature_id) AS repeats, count_if(geom IS NULL) AS no_geometry, string_agg(DISTINCT geom.kind, ',' ORDER BY geom.kind) AS kinds, round(avg(n), 6) AS mean_vertices FROM f GROUP BY 1""",
}
