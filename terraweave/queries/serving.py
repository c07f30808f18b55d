"""Pages, searches, histories, control fits and line networks over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.operators import control as C
from terraweave.operators import serving as S
from terraweave.plans.layers import layer, with_layers
from terraweave.session import table

_GCP = {
    "gcp_id": "p_partkey", "source_x": "CAST(p_partkey % 97 AS DOUBLE)", "source_y": "CAST(p_partkey % 89 AS DOUBLE)",
    "target_x": "CAST(p_partkey % 97 AS DOUBLE) * 1.01 - CAST(p_partkey % 89 AS DOUBLE) * 0.02 + 5 + CAST(p_partkey % 7 AS DOUBLE) / 100 + CASE WHEN p_partkey % 199 = 0 THEN 25 ELSE 0 END",
    "target_y": "CAST(p_partkey % 97 AS DOUBLE) * 0.02 + CAST(p_partkey % 89 AS DOUBLE) * 1.01 - 3 + CAST(p_partkey % 5 AS DOUBLE) / 100",
    "sigma_m": "CAST(p_partkey % 4 + 1 AS DOUBLE) / 25",
}
_EDGES = {
    "eid": "s_suppkey", "x1": "CAST(s_suppkey % 10 AS DOUBLE) * 10", "y1": "CAST(floor(s_suppkey / 10.0) AS DOUBLE) * 10",
    "x2": "CAST(s_suppkey % 10 AS DOUBLE) * 10 + 10 - CASE WHEN s_suppkey % 7 = 0 THEN 0.5 ELSE 0 END", "y2": "CAST(floor(s_suppkey / 10.0) AS DOUBLE) * 10",
}
_sql = lambda columns: ", ".join(f"{e} AS {c}" for c, e in columns.items())
_PATTERNS = {"digits": r"^[0-9]+$", "capitals": r"^[A-Z]+$", "hash_number": r"#[0-9]+$"}


def _gcp(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in _GCP.items()])


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {c}" for c, e in _EDGES.items()])


def x8_helmert(spark, sf_dir):
    return C.helmert(_gcp(spark, sf_dir)).select("n", *[F.round(c, 5).alias(c) for c in ("scale", "rotation", "tx", "ty", "rmse")])


def x8_affine(spark, sf_dir):
    return C.affine(_gcp(spark, sf_dir)).select("n", *[F.round(c, 5).alias(c) for c in ("a", "b", "c", "d", "tx", "ty", "rmse")])


def x8_blunders(spark, sf_dir):
    return C.blunders(_gcp(spark, sf_dir)).select("gcp_id", F.round("r", 5).alias("r"))


def t2_network(spark, sf_dir):
    return C.network_nodes(_edges(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("dangle").alias("dangles"), F.max("degree").alias("most"))


def j24_undershoots(spark, sf_dir):
    return C.undershoots(_edges(spark, sf_dir)).select("eid", "other", F.round("distance", 6).alias("distance"))


def p11_items(spark, sf_dir):
    """The third page of accepted orders of high value: paging is the feature."""
    o = table(spark, sf_dir, "orders").where("o_totalprice >= 1000 AND o_orderstatus <> 'P'")
    return S.paged(o.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 50, 25)


def p12_redacted(spark, sf_dir):
    return S.redacted(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name"])


def p13_problems(spark, sf_dir):
    wrong = S.problems(["c_name"], {"c_mktsegment": ["BUILDING", "MACHINERY"]}, {"c_name": "[02468]$"})
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(wrong).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def p17_search(spark, sf_dir):
    sources = [(table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "k"), ["s_name"]), (table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), ["c_name", "c_mktsegment"])]
    return S.searched(sources, "0001", "k", 30)


def j8_overlay(spark, sf_dir):
    return S.overlay(layer(spark, sf_dir, "buildings"), 100.0, 40.0, 260.0, 120.0).select("fid", "overlap", F.round("share", 6).alias("share"))


def w8_minted(spark, sf_dir):
    return S.minted(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.substring("c_mktsegment", 1, 4), "c_custkey").select("c_custkey", F.col("nonce").cast("bigint").alias("nonce"), "minted")


def x6_timeline(spark, sf_dir):
    """Orders and events of every user in one history, counted by kind."""
    parts = {"order": (table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderstatus"), "event": (table(spark, sf_dir, "events"), "user_id", "ts", "event_type")}
    return S.timeline(parts).groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("at").cast("timestamp_ntz").alias("last"))


def a21_columns(spark, sf_dir):
    return S.column_profile(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"], _PATTERNS)


def e1_extent(spark, sf_dir):
    return S.extent(layer(spark, sf_dir, "parcels_a"))


QUERIES = {
    "x8_helmert": x8_helmert, "x8_affine": x8_affine, "x8_blunders": x8_blunders, "t2_network": t2_network, "j24_undershoots": j24_undershoots, "items_page": p11_items, "redacted": p12_redacted, "validation": p13_problems,
    "search": p17_search, "j8_overlay": j8_overlay, "w8_minted": w8_minted, "x6_timeline": x6_timeline, "a21_columns": a21_columns, "extent": e1_extent,
}

_G = f"WITH g AS (SELECT {_sql(_GCP)} FROM part)"
_E = f"e AS (SELECT {_sql(_EDGES)} FROM supplier)"
_N = "format('{:.3f} {:.3f}', x1, y1)", "format('{:.3f} {:.3f}', x2, y2)"
ORACLES = {
    "x8_helmert": _G + """, w AS (SELECT *, 1 / pow(sigma_m, 2) AS w FROM g), m AS (SELECT sum(w * source_x) / sum(w) AS mx, sum(w * source_y) / sum(w) AS my, sum(w * target_x) / sum(w) AS nx, sum(w * target_y) / sum(w) AS ny FROM w),
d AS (SELECT w, mx, my, nx, ny, source_x - mx AS u, source_y - my AS v, target_x - nx AS p, target_y - ny AS q FROM w, m), s AS (SELECT sum(w * (u * p + v * q)) / sum(w * (u * u + v * v)) AS a, sum(w * (u * q - v * p)) / sum(w * (u * u + v * v)) AS b FROM d)
SELECT count(*) AS n, round(any_value(sqrt(a * a + b * b)), 5) AS scale, round(any_value(degrees(atan2(b, a))), 5) AS rotation, round(any_value(nx - a * mx + b * my), 5) AS tx, round(any_value(ny - b * mx - a * my), 5) AS ty, round(sqrt(avg(pow(p - a * u + b * v, 2) + pow(q - b * u - a * v, 2))), 5) AS rmse FROM d, s""",
    "x8_affine": _G + """, k AS (SELECT avg(source_x) AS mx, avg(source_y) AS my, avg(target_x) AS nx, avg(target_y) AS ny FROM g), d AS (SELECT *, source_x - mx AS u, source_y - my AS v, target_x - nx AS p, target_y - ny AS q FROM g, k),
s AS (SELECT sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * p) AS up, sum(v * p) AS vp, sum(u * q) AS uq, sum(v * q) AS vq FROM d),
c AS (SELECT (up * vv - vp * uv) / (uu * vv - uv * uv) AS a, (vp * uu - up * uv) / (uu * vv - uv * uv) AS b, (uq * vv - vq * uv) / (uu * vv - uv * uv) AS c, (vq * uu - uq * uv) / (uu * vv - uv * uv) AS d FROM s)
SELECT count(*) AS n, round(any_value(a), 5) AS a, round(any_value(b), 5) AS b, round(any_value(c), 5) AS c, round(any_value(c.d), 5) AS d, round(any_value(nx - a * mx - b * my), 5) AS tx, round(any_value(ny - c * mx - c.d * my), 5) AS ty, round(sqrt(avg(pow(p - a * u - b * v, 2) + pow(q - c * u - c.d * v, 2))), 5) AS rmse FROM d, c""",
    "x8_blunders": _G + """, d AS (SELECT gcp_id, target_x - source_x AS dx, target_y - source_y AS dy FROM g), m AS (SELECT median(dx) AS mx, median(dy) AS my FROM d), r AS (SELECT gcp_id, sqrt(pow(dx - mx, 2) + pow(dy - my, 2)) AS r FROM d, m), s AS (SELECT median(r) * 1.4826 AS s FROM r)
SELECT gcp_id, round(r, 5) AS r FROM r, s WHERE s > 0 AND r > 3 * s""",
    "t2_network": f"WITH RECURSIVE {_E}, " + f"""l AS (SELECT {_N[0]} AS a, {_N[1]} AS b FROM e), b AS (SELECT a, b FROM l UNION SELECT b, a FROM l), ends AS (SELECT a AS node FROM l UNION ALL SELECT b FROM l), dg AS (SELECT node, count(*) AS degree FROM ends GROUP BY 1),
t AS (SELECT node, node AS root FROM dg UNION SELECT b.b, t.root FROM t JOIN b ON b.a = t.node), c AS (SELECT node, min(root) AS component FROM t GROUP BY 1)
SELECT component, count(*) AS nodes, count(*) FILTER (WHERE degree = 1) AS dangles, max(degree) AS most FROM dg JOIN c USING (node) GROUP BY 1""",
    "j24_undershoots": f"WITH {_E}, " + """ends AS (SELECT eid, x1 AS x, y1 AS y FROM e UNION ALL SELECT eid, x2, y2 FROM e), dn AS (SELECT round(x, 3) AS x, round(y, 3) AS y FROM ends GROUP BY 1, 2 HAVING count(*) = 1),
d AS (SELECT ends.* FROM ends JOIN dn ON round(ends.x, 3) = dn.x AND round(ends.y, 3) = dn.y),
p AS (SELECT d.eid, e.eid AS other, d.x, d.y, greatest(0, least(1, ((d.x - e.x1) * (e.x2 - e.x1) + (d.y - e.y1) * (e.y2 - e.y1)) / (pow(e.x2 - e.x1, 2) + pow(e.y2 - e.y1, 2)))) AS t, e.* EXCLUDE (eid) FROM d JOIN e ON d.eid <> e.eid),
f AS (SELECT eid, other, x, y, sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2)) AS dist FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY eid, x, y ORDER BY dist, other) AS k FROM f WHERE dist > 0 AND dist <= 1)
SELECT eid, other, round(dist, 6) AS distance FROM n WHERE k = 1""",
    "items_page": "WITH o AS (SELECT * FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus <> 'P') SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM o) AS number_matched FROM o ORDER BY o_orderkey LIMIT 25 OFFSET 50",
    "redacted": "SELECT c_custkey, '[redacted]' AS c_name, c_mktsegment FROM customer",
    "validation": "SELECT 'domain:c_mktsegment' AS problem, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') HAVING count(*) > 0 UNION ALL SELECT 'pattern:c_name', count(*) FROM customer WHERE NOT regexp_matches(c_name, '[02468]$') HAVING count(*) > 0",
    "search": """WITH h AS (SELECT 0 AS source, s_suppkey::VARCHAR AS key, lower(s_name) AS text FROM supplier UNION ALL SELECT 1, c_custkey::VARCHAR, lower(c_name || ' ' || c_mktsegment) FROM customer) SELECT source, key, text FROM h WHERE contains(text, '0001') ORDER BY source, key LIMIT 30""",
    "j8_overlay": with_layers("buildings") + ", o AS (SELECT *, greatest(least(x2, 260) - greatest(x1, 100), 0) * greatest(least(y2, 120) - greatest(y1, 40), 0) AS overlap FROM buildings) SELECT fid, overlap, round(overlap / ((x2 - x1) * (y2 - y1)), 6) AS share FROM o WHERE overlap > 0",
    "w8_minted": "WITH n AS (SELECT c_custkey, c_mktsegment[:4] AS b, row_number() OVER (PARTITION BY c_mktsegment[:4] ORDER BY c_custkey) - 1 AS nonce FROM customer) SELECT c_custkey, nonce, b || '-' || nonce AS minted FROM n",
    "x6_timeline": "SELECT o_custkey AS entity, 'order' AS kind, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1 UNION ALL SELECT user_id, 'event', count(*), max(ts) FROM events GROUP BY 1",
    "a21_columns": "WITH u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::VARCHAR AS value FROM customer" for c in ("c_custkey", "c_name", "c_mktsegment")) + """) SELECT name, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS nulls, count(DISTINCT value) AS distinct_values, round(avg(length(value)), 6) AS mean_length, round(stddev_pop(length(value)), 6) AS length_deviation,
  min(try_cast(value AS DOUBLE)) AS least, max(try_cast(value AS DOUBLE)) AS most, """ + ", ".join(f"round(avg(regexp_matches(value, '{p}')::INT), 6) AS {n}" for n, p in _PATTERNS.items()) + " FROM u GROUP BY 1",
    "extent": with_layers("parcels_a") + " SELECT min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM parcels_a",
}
