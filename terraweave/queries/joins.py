"""Spatial and temporal joins on the derived layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.operators import grid
from terraweave.plans.layers import layer, with_layers
from terraweave.session import table

_MEETS = "r.x1 <= l.x2 + {r} AND r.x2 >= l.x1 - {r} AND r.y1 <= l.y2 + {r} AND r.y2 >= l.y1 - {r}"
_LAREA, _RAREA = "((l.x2 - l.x1) * (l.y2 - l.y1))", "((r.x2 - r.x1) * (r.y2 - r.y1))"
_OVER = "greatest(least(l.x2, r.x2) - greatest(l.x1, r.x1), 0) * greatest(least(l.y2, r.y2) - greatest(l.y1, r.y1), 0)"
_FAR = "sqrt(pow((l.x1 + l.x2 - r.x1 - r.x2) / 2, 2) + pow((l.y1 + l.y2 - r.y1 - r.y2) / 2, 2))"


def j1_blocking(spark, sf_dir):
    pairs = grid.blocking_join(layer(spark, sf_dir, "parcels_a"), layer(spark, sf_dir, "parcels_b"))
    return pairs.select("l_fid", "r_fid", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def j2_neighbours(spark, sf_dir):
    pairs = grid.neighbours(layer(spark, sf_dir, "parcels_a"), 40.0)
    return pairs.groupBy("l_fid").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("distance"), 6).alias("nearest"))


def j3_overlaps(spark, sf_dir):
    a = layer(spark, sf_dir, "parcels_b")
    pairs = grid.box_join(a, a).where("l_fid < r_fid").withColumn("overlap", grid.overlap())
    return pairs.where("overlap >= 0.25").select("l_fid", "r_fid", "overlap")


def j5_building_parcel(spark, sf_dir):
    out = grid.argmax_join(layer(spark, sf_dir, "buildings"), layer(spark, sf_dir, "parcels_a"))
    return out.select("fid", "parent", "covered")


def j9_nearest(spark, sf_dir):
    centre = lambda df: df.select("fid", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    near = grid.nearest_join(centre(layer(spark, sf_dir, "buildings")), centre(layer(spark, sf_dir, "parcels_b")), 30.0)
    return near.select("l_fid", "r_fid", F.round("distance", 6).alias("distance"))


def j19_unmatched(spark, sf_dir):
    a, b = layer(spark, sf_dir, "parcels_a"), layer(spark, sf_dir, "parcels_b")
    hit = grid.box_join(a, b).where(grid.overlap() > 0)
    left = a.join(hit.select(F.col("l_fid").alias("fid")).distinct(), "fid", "left_anti").select(F.lit("left").alias("side"), "fid")
    right = b.join(hit.select(F.col("r_fid").alias("fid")).distinct(), "fid", "left_anti").select(F.lit("right").alias("side"), "fid")
    return left.unionByName(right)


def j0_as_of(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), "o_orderkey", "o_totalprice")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_id")
    # The last order is unique by time and key; of orders at one time the largest key counts.
    last = orders.groupBy("k", "t").agg(F.max("o_orderkey").alias("o_orderkey"))
    return grid.as_of_join(events, last, ["k"], "t", ["o_orderkey"], 30 * 86_400).select("event_id", "o_orderkey")


def p1_bbox_filter(spark, sf_dir):
    a = layer(spark, sf_dir, "parcels_a")
    return a.where("x1 <= 400 AND x2 >= 100 AND y1 <= 300 AND y2 >= 50").select("fid", "x1", "y1", "x2", "y2")


def u7_components(spark, sf_dir):
    from terraweave.operators.graph import components

    a = layer(spark, sf_dir, "buildings")
    pairs = grid.box_join(a, a, 6.0).where("l_fid < r_fid").select(F.col("l_fid").alias("a"), F.col("r_fid").alias("b"))
    return components(a.select(F.col("fid").alias("node")), pairs)


QUERIES = {
    "j0_as_of": j0_as_of, "j1_blocking": j1_blocking, "j2_neighbours": j2_neighbours, "j3_overlaps": j3_overlaps, "j5_building_parcel": j5_building_parcel,
    "j9_nearest": j9_nearest, "j19_unmatched": j19_unmatched, "filter_bbox": p1_bbox_filter, "u7_components": u7_components,
}

ORACLES = {
    "j0_as_of": """
WITH o AS (SELECT o_custkey AS k, o_orderdate AS t, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
SELECT e.event_id, o.o_orderkey FROM events AS e ASOF LEFT JOIN o ON e.user_id = o.k AND e.ts >= o.t""",
    "j1_blocking": with_layers("parcels_a", "parcels_b") + f""",
p AS (SELECT l.fid AS l_fid, r.fid AS r_fid, {_FAR} AS d FROM parcels_a AS l JOIN parcels_b AS r ON {_MEETS.format(r=3)} AND {_RAREA} / {_LAREA} BETWEEN 0.08 AND 12),
n AS (SELECT *, row_number() OVER (PARTITION BY l_fid ORDER BY d, r_fid) AS rank FROM p)
SELECT l_fid, r_fid, round(d, 6) AS distance, rank FROM n WHERE rank <= 8""",
    "j2_neighbours": with_layers("parcels_a") + """,
c AS (SELECT fid, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM parcels_a)
SELECT l.fid AS l_fid, count(*) AS n, round(min(sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2))), 6) AS nearest
FROM c AS l JOIN c AS r ON r.x BETWEEN l.x - 40 AND l.x + 40 AND r.y BETWEEN l.y - 40 AND l.y + 40 AND l.fid <> r.fid GROUP BY 1""",
    "j3_overlaps": with_layers("parcels_b") + f"""
SELECT l.fid AS l_fid, r.fid AS r_fid, {_OVER} AS overlap FROM parcels_b AS l JOIN parcels_b AS r ON l.fid < r.fid AND {_MEETS.format(r=0)} WHERE {_OVER} >= 0.25""",
    "j5_building_parcel": with_layers("buildings", "parcels_a") + f""",
p AS (SELECT l.fid, r.fid AS parent, {_OVER} AS covered FROM buildings AS l JOIN parcels_a AS r ON {_MEETS.format(r=0)} WHERE {_OVER} > 0 AND {_OVER} >= 0.25 * {_LAREA}),
b AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY covered DESC, parent) AS rn FROM p)
SELECT l.fid, b.parent, coalesce(b.covered, 0.0) AS covered FROM buildings AS l LEFT JOIN b ON l.fid = b.fid AND b.rn = 1""",
    "j9_nearest": with_layers("buildings", "parcels_b") + """,
a AS (SELECT fid, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM buildings), c AS (SELECT fid, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM parcels_b),
p AS (SELECT a.fid AS l_fid, c.fid AS r_fid, sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2)) AS d FROM a JOIN c ON c.x BETWEEN a.x - 30 AND a.x + 30 AND c.y BETWEEN a.y - 30 AND a.y + 30),
n AS (SELECT *, row_number() OVER (PARTITION BY l_fid ORDER BY d, r_fid) AS rn FROM p WHERE d <= 30)
SELECT l_fid, r_fid, round(d, 6) AS distance FROM n WHERE rn = 1""",
    "j19_unmatched": with_layers("parcels_a", "parcels_b") + f""",
h AS (SELECT l.fid AS lf, r.fid AS rf FROM parcels_a AS l JOIN parcels_b AS r ON {_MEETS.format(r=0)} WHERE {_OVER} > 0)
SELECT 'left' AS side, fid FROM parcels_a WHERE fid NOT IN (SELECT lf FROM h) UNION ALL SELECT 'right', fid FROM parcels_b WHERE fid NOT IN (SELECT rf FROM h)""",
    "filter_bbox": with_layers("parcels_a") + "\nSELECT fid, x1, y1, x2, y2 FROM parcels_a WHERE x1 <= 400 AND x2 >= 100 AND y1 <= 300 AND y2 >= 50",
    "u7_components": "WITH RECURSIVE " + with_layers("buildings")[5:] + f""",
e AS (SELECT l.fid AS a, r.fid AS b FROM buildings AS l JOIN buildings AS r ON l.fid <> r.fid AND {_MEETS.format(r=6)}),
t AS (SELECT fid AS node, fid AS root FROM buildings UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node)
SELECT node, min(root) AS component FROM t GROUP BY node""",
}
