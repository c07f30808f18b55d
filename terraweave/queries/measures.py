"""Measures and rollups over the derived layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.operators import linkage as L
from terraweave.operators import measures as M
from terraweave.plans.layers import layer, with_layers
from terraweave.session import durable, table

_DIMENSIONS = {
    "placement": "CAST((fid * 7) % 101 AS DOUBLE) / 100",
    "agreement": "CAST((fid * 13) % 101 AS DOUBLE) / 100",
    "topological": "CAST((fid * 17) % 101 AS DOUBLE) / 100",
    "completeness": "CAST((fid * 19) % 101 AS DOUBLE) / 100",
    "currency": "CASE WHEN fid % 23 = 0 THEN NULL ELSE CAST((fid * 29) % 101 AS DOUBLE) / 100 END",
    "lineage": "CAST((fid * 31) % 101 AS DOUBLE) / 100",
}


def _rated(spark, sf_dir):
    a = layer(spark, sf_dir, "parcels_a").selectExpr("*", *[f"{e} AS {c}" for c, e in _DIMENSIONS.items()])
    rated = a.withColumn("confidence", M.composite()).withColumn("weakest", M.weakest())
    return rated.withColumn("grade", M.grade(F.col("confidence")))


def _checks(spark, sf_dir):
    return L.scored_pairs(layer(spark, sf_dir, "parcels_a"), layer(spark, sf_dir, "parcels_b")).where("iou >= 0.3").select("dx", "dy")


def b4_confidence(spark, sf_dir):
    return _rated(spark, sf_dir).select("fid", F.round("confidence", 6).alias("confidence"), "grade", "weakest")


def a2_quality_by_ward(spark, sf_dir):
    """The 60 wards of most parcels: a top-k report, as in the feature."""
    r = _rated(spark, sf_dir)
    out = r.groupBy("ward").agg(F.count(F.lit(1)).alias("parcels"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("grade").isin("A", "B")).alias("publishable"), F.count_if(F.col("grade").isin("D", "E")).alias("to_check"), F.round(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), 4).alias("area"))
    return out.orderBy(F.desc("parcels"), "ward").limit(60)


def a29_quality_cube(spark, sf_dir):
    r = _rated(spark, sf_dir).cube("zone", "grade").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.grouping_id().alias("level"))
    return r.select("zone", "grade", "n", "mean_confidence", F.col("level").cast("bigint").alias("level"))


def a9_accuracy(spark, sf_dir):
    a = M.accuracy_assessment(_checks(spark, sf_dir), 2.0)
    return a.select("n", *[F.round(c, 6).alias(c) for c in ("rmse_x", "rmse_y", "rmse", "ce90", "ce95", "nssda", "bias", "scatter")], "within_spec")


def a10_moran(spark, sf_dir):
    b = layer(spark, sf_dir, "buildings").select("fid", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), "height")
    return M.morans_i(b, "height", 100.0).select("n", "w", F.round("moran", 6).alias("moran"))


def a11_completeness(spark, sf_dir):
    a, b = layer(spark, sf_dir, "parcels_a"), layer(spark, sf_dir, "parcels_b")
    links = L.mutual_assignment(L.scored_pairs(a, b)).where("state = 'accepted'")
    c = M.completeness(links, a, b)
    return c.select("matched", "omission", "commission", *[F.round(x, 6).alias(x) for x in ("completeness", "correctness", "f1")])


def a17_built_form(spark, sf_dir):
    from terraweave.operators.grid import argmax_join

    placed = argmax_join(layer(spark, sf_dir, "buildings"), layer(spark, sf_dir, "parcels_a")).where("parent IS NOT NULL")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    rolled = placed.groupBy(F.col("parent").alias("fid")).agg(F.count(F.lit(1)).alias("buildings"), F.sum(area).alias("built_up"), F.max("height").alias("tallest"))
    p = layer(spark, sf_dir, "parcels_a").select("fid", area.alias("area"))
    return p.join(rolled, "fid").select("fid", "buildings", "built_up", "tallest", F.round(100 * F.col("built_up") / F.col("area"), 6).alias("coverage"))


def a20_profile(spark, sf_dir):
    """Null rate and distinct values of every column of orders, over unpivoted cells; amounts to the cent and times to the second as text."""
    shown = {"o_totalprice": F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")}
    o = table(spark, sf_dir, "orders")
    cells = o.select(*[shown.get(c, F.col(c).cast("string")).alias(c) for c in o.columns]).unpivot([], o.columns, "name", "value")
    return cells.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.countDistinct(F.substring("value", 1, 64)).alias("distinct_values"), F.round(F.avg(F.length("value")), 6).alias("mean_length"))


def a22_dependencies(spark, sf_dir):
    return M.functional_dependencies(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


def a23_texts(spark, sf_dir):
    """Of the whole texts of every source of documents, the divergence of their bigrams from those of all other sources."""
    counts = M.bigram_counts(table(spark, sf_dir, "documents"), "source", "text")
    return M.divergence_from_rest(durable(counts), "source", "gram").select("source", F.round("divergence", 6).alias("divergence"))


def w11_latest(spark, sf_dir):
    """The last event of every user."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("l")).select("user_id", "l.event_id", "l.event_type")


QUERIES = {
    "b4_confidence": b4_confidence, "a2_quality_by_ward": a2_quality_by_ward, "a29_quality_cube": a29_quality_cube, "a9_accuracy": a9_accuracy, "a10_moran": a10_moran, "a11_completeness": a11_completeness,
    "a17_built_form": a17_built_form, "a20_profile": a20_profile, "a22_dependencies": a22_dependencies, "a23_texts": a23_texts, "w11_latest": w11_latest,
}

_RATED = with_layers("parcels_a") + ",\nd AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in _DIMENSIONS.items()) + """ FROM parcels_a),
c AS (SELECT *, 0.28 * placement + 0.22 * agreement + 0.18 * topological + 0.14 * completeness + 0.10 * coalesce(currency, 0.5) + 0.08 * lineage AS confidence,
  least({'v': placement, 'k': 'placement'}, {'v': agreement, 'k': 'agreement'}, {'v': topological, 'k': 'topological'}, {'v': completeness, 'k': 'completeness'}, {'v': coalesce(currency, 0.5), 'k': 'currency'}, {'v': lineage, 'k': 'lineage'}).k AS weakest FROM d),
rated AS (SELECT *, CASE WHEN confidence >= 0.9 THEN 'A' WHEN confidence >= 0.75 THEN 'B' WHEN confidence >= 0.6 THEN 'C' WHEN confidence >= 0.4 THEN 'D' ELSE 'E' END AS grade FROM c)"""
from terraweave.queries.linkage import _LINKS, _SCORED  # noqa: E402

ORACLES = {
    "b4_confidence": _RATED + " SELECT fid, round(confidence, 6) AS confidence, grade, weakest FROM rated",
    "a2_quality_by_ward": _RATED + """ SELECT ward, count(*) AS parcels, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE grade IN ('A', 'B')) AS publishable,
  count(*) FILTER (WHERE grade IN ('D', 'E')) AS to_check, round(sum((x2 - x1) * (y2 - y1)), 4) AS area FROM rated GROUP BY 1 ORDER BY parcels DESC, ward LIMIT 60""",
    "a29_quality_cube": _RATED + " SELECT zone, grade, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, grouping(zone, grade) AS level FROM rated GROUP BY CUBE (zone, grade)",
    "a9_accuracy": _SCORED + """, ch AS (SELECT dx, dy, sqrt(dx * dx + dy * dy) AS r FROM scored WHERE iou >= 0.3), mm AS (SELECT median(r) AS m, count(*) AS n_all FROM ch),
dv AS (SELECT ch.*, mm.*, abs(r - m) AS dev FROM ch, mm), sc AS (SELECT median(dev) * 1.4826 AS s FROM dv), kept AS (SELECT * FROM dv, sc WHERE n_all < 10 OR s = 0 OR dev <= 3 * s),
st AS (SELECT count(*) AS n, sqrt(avg(dx * dx)) AS rx, sqrt(avg(dy * dy)) AS ry, sqrt(avg(r * r)) AS rr, quantile_cont(r, 0.9) AS c90, quantile_cont(r, 0.95) AS c95, sqrt(avg(dx) * avg(dx) + avg(dy) * avg(dy)) AS b FROM kept)
SELECT n, round(rx, 6) AS rmse_x, round(ry, 6) AS rmse_y, round(rr, 6) AS rmse, round(c90, 6) AS ce90, round(c95, 6) AS ce95, round(rr * 1.7308, 6) AS nssda, round(b, 6) AS bias, round(sqrt(greatest(rr * rr - b * b, 0)), 6) AS scatter, c95 <= 2 AS within_spec FROM st""",
    "a10_moran": with_layers("buildings") + """, p AS (SELECT fid, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, height FROM buildings),
d AS (SELECT a.fid AS l, b.fid AS r, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p AS a JOIN p AS b ON b.x BETWEEN a.x - 100 AND a.x + 100 AND b.y BETWEEN a.y - 100 AND a.y + 100),
s AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, r) AS n0 FROM d WHERE d <= 100),
k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, r) AS n FROM s WHERE n0 <= 7 AND l <> r),
e AS (SELECT l, r FROM k WHERE n <= 6 UNION SELECT r, l FROM k WHERE n <= 6),
z AS (SELECT fid, height - avg(height) OVER () AS z FROM p), ss AS (SELECT sum(z * z) AS ss, count(*) AS n FROM z),
c AS (SELECT sum(a.z * b.z) AS c, count(*) AS w FROM e JOIN z AS a ON a.fid = e.l JOIN z AS b ON b.fid = e.r)
SELECT n, w, round(n / w * c / ss, 6) AS moran FROM ss, c""",
    "a11_completeness": _LINKS + """, m AS (SELECT count(*) FILTER (WHERE state = 'accepted') AS k FROM links), a AS (SELECT count(*) AS na FROM parcels_a), b AS (SELECT count(*) AS nb FROM parcels_b)
SELECT k AS matched, na - k AS omission, nb - k AS commission, round(k / na, 6) AS completeness, round(k / nb, 6) AS correctness, round(2 * (k / na) * (k / nb) / (k / na + k / nb), 6) AS f1 FROM m, a, b""",
    "a17_built_form": with_layers("buildings", "parcels_a") + """,
o AS (SELECT l.fid, r.fid AS parent, l.height, (l.x2 - l.x1) * (l.y2 - l.y1) AS a, greatest(least(l.x2, r.x2) - greatest(l.x1, r.x1), 0) * greatest(least(l.y2, r.y2) - greatest(l.y1, r.y1), 0) AS c
  FROM buildings AS l JOIN parcels_a AS r ON r.x1 <= l.x2 AND r.x2 >= l.x1 AND r.y1 <= l.y2 AND r.y2 >= l.y1),
b AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY c DESC, parent) AS rn FROM o WHERE c > 0 AND c >= 0.25 * a),
g AS (SELECT parent, count(*) AS buildings, sum(a) AS built_up, max(height) AS tallest FROM b WHERE rn = 1 GROUP BY 1)
SELECT fid, buildings, built_up, tallest, round(100 * built_up / ((x2 - x1) * (y2 - y1)), 6) AS coverage FROM parcels_a JOIN g ON fid = parent""",
    "a20_profile": """
WITH u AS (SELECT 'o_orderkey' AS name, o_orderkey::VARCHAR AS value FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders
  UNION ALL SELECT 'o_totalprice', o_totalprice::DECIMAL(18, 2)::VARCHAR FROM orders UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders)
SELECT name, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS nulls, count(DISTINCT value[:64]) AS distinct_values, round(avg(length(value)), 6) AS mean_length FROM u GROUP BY 1""",
    "a22_dependencies": " UNION ALL ".join(
        f"SELECT '{a}' AS determinant, '{b}' AS dependent WHERE (SELECT max(d) FROM (SELECT count(DISTINCT {b}) AS d FROM nation WHERE {a} IS NOT NULL GROUP BY {a})) <= 1"
        for a in ("n_nationkey", "n_name", "n_regionkey")
        for b in ("n_nationkey", "n_name", "n_regionkey")
        if a != b
    ),
    "a23_texts": """
WITH c AS (SELECT source, gram, count(*) AS n FROM (SELECT source, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS gram FROM documents WHERE length(text) > 1) GROUP BY 1, 2),
s AS (SELECT source, sum(n) AS g, sum(sum(n)) OVER () AS a FROM c GROUP BY 1), t AS (SELECT gram, sum(n) AS t FROM c GROUP BY 1),
d AS (SELECT s.source, coalesce(c.n, 0) / g AS p, (t.t - coalesce(c.n, 0)) / nullif(a - g, 0) AS q FROM s CROSS JOIN t LEFT JOIN c ON c.gram = t.gram AND c.source IS NOT DISTINCT FROM s.source)
SELECT source, round((sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2, 6) AS divergence FROM d GROUP BY 1""",
    "w11_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
}
