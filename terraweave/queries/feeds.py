"""Feeds, rasters, readers and published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.operators import raster
from terraweave.plans.layers import layer, with_layers
from terraweave.session import scratch_path, table
from terraweave.sources import readers, writers
from terraweave.streaming import feeds

_CELLS = "SELECT event_id // 100 AS r, event_id % 100 AS c, CAST(event_id % 13 AS DOUBLE) / 4 + CASE WHEN (event_id // 100) % 40 BETWEEN 3 AND 5 AND event_id % 100 BETWEEN 20 AND 24 THEN 9 ELSE 0 END AS z FROM events"


def _cells(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.selectExpr("event_id div 100 AS r", "event_id % 100 AS c", "CAST(event_id % 13 AS DOUBLE) / 4 + CASE WHEN (event_id div 100) % 40 BETWEEN 3 AND 5 AND event_id % 100 BETWEEN 20 AND 24 THEN 9 ELSE 0 END AS z")


def s1_windows(spark, sf_dir):
    out = feeds.windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def s2_sessions(spark, sf_dir):
    out = feeds.sessions(table(spark, sf_dir, "events"), "6 hours")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


_TYPES = "CASE c_custkey % 4 WHEN 0 THEN array('click', 'view') WHEN 1 THEN array('purchase') WHEN 2 THEN array('click', 'purchase', 'error') ELSE array() END"


def p18_deliveries(spark, sf_dir):
    """How many events each customer's subscription is sent, by its types and least value."""
    subs = table(spark, sf_dir, "customer").selectExpr("c_custkey AS sub_id", f"CAST({_TYPES} AS ARRAY<STRING>) AS event_types", "CAST(50 + c_custkey % 50 AS DOUBLE) AS least", "c_nationkey <> 3 AS active")
    return feeds.delivery_counts(table(spark, sf_dir, "events"), subs)


def r2_opening(spark, sf_dir):
    return raster.dilated(raster.eroded(_cells(spark, sf_dir), 1, "z", "e"), 1, "e", "opened").select("r", "c", "opened")


def r3_slope(spark, sf_dir):
    s = raster.slope_aspect(_cells(spark, sf_dir))
    return s.select("r", "c", F.round("slope", 6).alias("slope"), F.round("hillshade", 6).alias("hillshade"))


def r4_structures(spark, sf_dir):
    high = raster.regions(_cells(spark, sf_dir), "z > 8")
    return high.groupBy("region").agg(F.count(F.lit(1)).alias("cells"), F.max("z").alias("tallest"))


def r6_zonal(spark, sf_dir):
    """Statistics of the cells under every building."""
    z = raster.zonal(_cells(spark, sf_dir), layer(spark, sf_dir, "buildings"))
    return z.select("fid", "cells", F.round("mean", 6).alias("mean"), "max", F.round("deviation", 6).alias("deviation"))


def k1_geojson(spark, sf_dir):
    """Parcels written as GeoJSON lines, read again and measured."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1"))
    p = layer(spark, sf_dir, "parcels_a").select("fid", F.struct(F.lit("Polygon").alias("kind"), F.array(ring).alias("rings")).alias("geom"), "ward", "land_use")
    path = scratch_path(spark, "geojson")
    writers.write_geojson_lines(p, path)
    from terraweave.functions import rings

    back = readers.read_geojson_lines(spark, path, "A")
    return back.select(F.col("fid").cast("bigint").alias("fid"), rings.area(F.col("geom.rings")[0]).alias("area"), F.col("properties")["ward"].cast("bigint").alias("ward"), F.col("properties")["land_use"].alias("land_use"))


def k3_merge(spark, sf_dir):
    a, b = layer(spark, sf_dir, "parcels_a").select("fid", "ward", "land_use"), layer(spark, sf_dir, "parcels_b").select("fid", "ward", "land_use")
    return writers.merged(a, b, ["fid"])


def k6_vertices(spark, sf_dir):
    vertices, objects = writers.city_vertices(layer(spark, sf_dir, "buildings"))
    return objects.select("fid", F.get("vertices", F.lit(0)).alias("first"), F.get("vertices", F.lit(7)).alias("last"))


QUERIES = {
    "s1_windows": s1_windows, "s2_sessions": s2_sessions, "sub_deliveries": p18_deliveries, "r2_opening": r2_opening, "r3_slope": r3_slope, "r4_structures": r4_structures, "r6_zonal": r6_zonal, 
    "k1_geojson": k1_geojson, "k3_merge": k3_merge, "k6_vertices": k6_vertices,
}

_WINDOW = "(PARTITION BY {p} ORDER BY {o} RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
ORACLES = {
    "s1_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "s2_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), k AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM k GROUP BY 1""",
    "sub_deliveries": "WITH s AS (SELECT c_custkey AS sub_id, " + _TYPES.replace("array(", "list_value(") + """ AS types, CAST(50 + c_custkey % 50 AS DOUBLE) AS least FROM customer WHERE c_nationkey <> 3)
SELECT sub_id, count(*) AS n FROM s JOIN events AS e ON e.value >= s.least AND (len(s.types) = 0 OR list_contains(s.types, e.event_type)) GROUP BY 1""",
    "r4_structures": f"""WITH RECURSIVE t AS ({_CELLS}), h AS (SELECT r * 1048576 + c AS k, z FROM t WHERE z > 8),
e AS (SELECT a.k AS a, b.k AS b FROM h AS a JOIN h AS b ON abs(a.k - b.k) IN (1, 1048576)), g AS (SELECT k AS node, k AS root FROM h UNION SELECT e.b, g.root FROM g JOIN e ON e.a = g.node),
m AS (SELECT node, min(root) AS region FROM g GROUP BY 1) SELECT region, count(*) AS cells, max(z) AS tallest FROM m JOIN h ON h.k = m.node GROUP BY 1""",
    "r2_opening": f"""WITH t AS ({_CELLS}), a AS (SELECT *, min(z) OVER {_WINDOW.format(p='r', o='c')} AS v FROM t), b AS (SELECT *, min(v) OVER {_WINDOW.format(p='c', o='r')} AS e FROM a),
d AS (SELECT *, max(e) OVER {_WINDOW.format(p='r', o='c')} AS w FROM b) SELECT r, c, max(w) OVER {_WINDOW.format(p='c', o='r')} AS opened FROM d""",
    "r3_slope": f"""WITH t AS ({_CELLS}), g AS (SELECT r, c, (lead(z) OVER (PARTITION BY r ORDER BY c) - lag(z) OVER (PARTITION BY r ORDER BY c)) / 2 AS dx, (lead(z) OVER (PARTITION BY c ORDER BY r) - lag(z) OVER (PARTITION BY c ORDER BY r)) / 2 AS dy FROM t),
s AS (SELECT r, c, atan(sqrt(dx * dx + dy * dy)) AS s, atan2(dy, -dx) AS a, dx + dy AS ok FROM g)
SELECT r, c, round(degrees(s), 6) AS slope, CASE WHEN ok IS NULL THEN 0 ELSE round(greatest(cos(0.7853981633974483) * cos(s) + sin(0.7853981633974483) * sin(s) * cos(2.356194490192345 - a), 0), 6) END AS hillshade FROM s""",
    "r6_zonal": with_layers("buildings") + f""", t AS ({_CELLS})
SELECT fid, count(*) AS cells, round(avg(t.z), 6) AS mean, max(t.z) AS max, round(stddev_pop(t.z), 6) AS deviation FROM buildings JOIN t ON t.c + 0.5 BETWEEN x1 AND x2 AND t.r + 0.5 BETWEEN y1 AND y2 GROUP BY 1""",
    "k1_geojson": with_layers("parcels_a") + " SELECT fid, (x2 - x1) * (y2 - y1) AS area, ward, land_use FROM parcels_a",
    "k3_merge": with_layers("parcels_a", "parcels_b") + " SELECT fid, ward, land_use FROM parcels_b UNION ALL SELECT fid, ward, land_use FROM parcels_a WHERE fid NOT IN (SELECT fid FROM parcels_b)",
    "k6_vertices": with_layers("buildings") + """, c AS (SELECT fid, 0 AS k, round(x1 / 0.001)::BIGINT AS x, round(y1 / 0.001)::BIGINT AS y, 0::BIGINT AS z FROM buildings UNION ALL SELECT fid, 1, round(x2 / 0.001), round(y1 / 0.001), 0 FROM buildings UNION ALL SELECT fid, 2, round(x2 / 0.001), round(y2 / 0.001), 0 FROM buildings
UNION ALL SELECT fid, 3, round(x1 / 0.001), round(y2 / 0.001), 0 FROM buildings UNION ALL SELECT fid, 4, round(x1 / 0.001), round(y1 / 0.001), round(height / 0.001) FROM buildings UNION ALL SELECT fid, 5, round(x2 / 0.001), round(y1 / 0.001), round(height / 0.001) FROM buildings
UNION ALL SELECT fid, 6, round(x2 / 0.001), round(y2 / 0.001), round(height / 0.001) FROM buildings UNION ALL SELECT fid, 7, round(x1 / 0.001), round(y2 / 0.001), round(height / 0.001) FROM buildings),
v AS (SELECT *, dense_rank() OVER (ORDER BY x, y, z) - 1 AS vertex FROM c) SELECT fid, max(CASE WHEN k = 0 THEN vertex END) AS first, max(CASE WHEN k = 7 THEN vertex END) AS last FROM v GROUP BY 1""",
}
