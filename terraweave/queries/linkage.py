"""Links between two parcel layers, and what changed between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.operators import linkage as L
from terraweave.operators.graph import components
from terraweave.plans.layers import layer, with_layers


def _layers(spark, sf_dir):
    return layer(spark, sf_dir, "parcels_a"), layer(spark, sf_dir, "parcels_b")


def m1_features(spark, sf_dir):
    s = L.scored_pairs(*_layers(spark, sf_dir))
    return s.select("l_fid", "r_fid", *[F.round(c, 6).alias(c) for c in ("iou", "containment", "dist_norm", "log_area")], "attr_ward", "attr_use")


def m6_weak_labels(spark, sf_dir):
    return L.scored_pairs(*_layers(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def m9_links(spark, sf_dir):
    links = L.mutual_assignment(L.scored_pairs(*_layers(spark, sf_dir)))
    return links.select("l_fid", "r_fid", F.round("score", 6).alias("score"), "state")


def a7_offset(spark, sf_dir):
    o = L.registration_offset(L.scored_pairs(*_layers(spark, sf_dir)))
    return o.select("n", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "offset", "bearing", "rms")], "significant")


def x1_changes(spark, sf_dir):
    a, b = _layers(spark, sf_dir)
    links = L.mutual_assignment(L.scored_pairs(a, b)).where("state = 'accepted'")
    return L.changes(a, b, links, (1.5, 0.5)).select("fid", "change", F.round("area_delta", 6).alias("area_delta"))


def a5_change_summary(spark, sf_dir):
    return x1_changes(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area_delta"), 4).alias("area"))


def a25_calibration(spark, sf_dir):
    """Calibration of the score against the weak labels in ten equal bins, the last one open at 1."""
    s = L.scored_pairs(*_layers(spark, sf_dir)).where("label >= 0 AND score < 1")
    bins = s.groupBy(F.floor(F.col("score") * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("confidence"), F.avg("label").alias("accuracy"))
    return bins.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def m13_groups(spark, sf_dir):
    live = L.scored_pairs(*_layers(spark, sf_dir)).where("score >= 0.35 AND iou > 0")
    left, right = (F.concat(F.lit(f"{s}:"), F.col(f"{s}_fid").cast("string")) for s in "lr")
    links = live.select(left.alias("a"), right.alias("b"))
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    return L.cardinality_groups(live, components(nodes, links))


QUERIES = {"m1_features": m1_features, "m6_weak_labels": m6_weak_labels, "m9_links": m9_links, "m13_groups": m13_groups, "a5_change_summary": a5_change_summary, "a7_offset": a7_offset, "a25_calibration": a25_calibration, "x1_changes": x1_changes}

_SCORED = with_layers("parcels_a", "parcels_b") + """,
p AS (SELECT l.fid AS l_fid, r.fid AS r_fid, (l.x2 - l.x1) * (l.y2 - l.y1) AS l_area, (r.x2 - r.x1) * (r.y2 - r.y1) AS r_area,
  greatest(least(l.x2, r.x2) - greatest(l.x1, r.x1), 0) * greatest(least(l.y2, r.y2) - greatest(l.y1, r.y1), 0) AS inter,
  (r.x1 + r.x2 - l.x1 - l.x2) / 2 AS dx, (r.y1 + r.y2 - l.y1 - l.y2) / 2 AS dy,
  (l.ward = r.ward)::INT::DOUBLE AS attr_ward, (l.land_use = r.land_use)::INT::DOUBLE AS attr_use
  FROM parcels_a AS l JOIN parcels_b AS r ON r.x1 <= l.x2 + 3 AND r.x2 >= l.x1 - 3 AND r.y1 <= l.y2 + 3 AND r.y2 >= l.y1 - 3),
k AS (SELECT *, row_number() OVER (PARTITION BY l_fid ORDER BY sqrt(dx * dx + dy * dy), r_fid) AS nth FROM p WHERE r_area / l_area BETWEEN 0.08 AND 12),
f AS (SELECT *, inter / (l_area + r_area - inter) AS iou, inter / least(l_area, r_area) AS containment, sqrt(dx * dx + dy * dy) / sqrt(least(l_area, r_area) / 3.141592653589793) AS dist_norm, abs(ln(r_area / l_area)) AS log_area FROM k WHERE nth <= 8),
g AS (SELECT *, row_number() OVER (PARTITION BY l_fid ORDER BY iou DESC, l_fid, r_fid) - 1 AS rank_left, row_number() OVER (PARTITION BY r_fid ORDER BY iou DESC, l_fid, r_fid) - 1 AS rank_right,
  max(iou) OVER (PARTITION BY l_fid) AS best_left, max(iou) OVER (PARTITION BY r_fid) AS best_right FROM f WHERE iou > 0 OR containment > 0.02 OR dist_norm <= 2.5),
h AS (SELECT *, rank_left = 0 AND rank_right = 0 AND iou > 0 AS mutual, greatest(best_left, best_right) AS best FROM g),
v AS (SELECT *,
  (iou >= 0.62 AND mutual) OR (containment >= 0.85 AND mutual AND exp(-log_area) >= 0.35 AND dist_norm <= 0.9) AS yes,
  (iou <= 1e-9 AND dist_norm > 5) OR (log_area > 2.3 AND containment < 0.55) OR (iou < 0.15 AND best_left > 0.65 AND best_right > 0.65) OR (NOT mutual AND best >= 0.55 AND iou BETWEEN 0.05 AND 0.65 AND iou <= 0.55 * best) AS nope FROM h),
scored AS (SELECT *, CASE WHEN yes AND NOT nope THEN 1 WHEN nope AND NOT yes THEN 0 ELSE -1 END AS label,
  0.34 * iou + 0.16 * containment + 0.18 * exp(-dist_norm / 1.5) + 0.12 + 0.10 * exp(-log_area) + 0.10 * (attr_ward + attr_use) / 2 AS score FROM v)"""
_LINKS = _SCORED + """,
best AS (SELECT *, row_number() OVER (PARTITION BY l_fid ORDER BY score DESC, l_fid, r_fid) AS na, row_number() OVER (PARTITION BY r_fid ORDER BY score DESC, l_fid, r_fid) AS nb FROM scored),
links AS (SELECT *, CASE WHEN score >= 0.55 THEN 'accepted' ELSE 'flagged' END AS state FROM best WHERE na = 1 AND nb = 1 AND score >= 0.35)"""
_CHANGES = _LINKS + """,
c AS (SELECT l_fid AS fid, CASE WHEN r_area <= l_area * 0.25 THEN 'demolition' WHEN (r_area - l_area) / l_area >= 0.08 AND r_area - l_area >= 6 THEN 'extension'
  WHEN (r_area - l_area) / l_area <= -0.08 AND r_area - l_area <= -6 THEN 'reduction' WHEN abs((r_area - l_area) / l_area) < 0.08 AND sqrt(pow(dx - 1.5, 2) + pow(dy - 0.5, 2)) > 0.75 THEN 'displacement' ELSE 'no_change' END AS change,
  r_area - l_area AS d FROM links WHERE state = 'accepted'
  UNION ALL SELECT fid, 'removed', -(x2 - x1) * (y2 - y1) FROM parcels_a WHERE fid NOT IN (SELECT l_fid FROM links WHERE state = 'accepted')
  UNION ALL SELECT fid, 'new', (x2 - x1) * (y2 - y1) FROM parcels_b WHERE fid NOT IN (SELECT r_fid FROM links WHERE state = 'accepted'))"""

ORACLES = {
    "m1_features": _SCORED + " SELECT l_fid, r_fid, round(iou, 6) AS iou, round(containment, 6) AS containment, round(dist_norm, 6) AS dist_norm, round(log_area, 6) AS log_area, attr_ward, attr_use FROM scored",
    "m6_weak_labels": _SCORED + " SELECT label, count(*) AS n, round(avg(score), 6) AS mean_score FROM scored GROUP BY 1",
    "m9_links": _LINKS + " SELECT l_fid, r_fid, round(score, 6) AS score, state FROM links",
    "a7_offset": _SCORED + """, good AS (SELECT * FROM scored WHERE iou >= 0.55), mid AS (SELECT median(dx) AS mx, median(dy) AS my, count(*) AS n FROM good),
s AS (SELECT mx, my, n, sqrt(avg(pow(dx - mx, 2) + pow(dy - my, 2))) AS rms FROM good, mid GROUP BY 1, 2, 3)
SELECT n, round(mx, 6) AS dx, round(my, 6) AS dy, round(sqrt(mx * mx + my * my), 6) AS "offset", round((degrees(atan2(mx, my)) + 360) % 360, 6) AS bearing, round(rms, 6) AS rms, n >= 25 AND sqrt(mx * mx + my * my) >= 0.3 AS significant FROM s""",
    "x1_changes": _CHANGES + " SELECT fid, change, round(d, 6) AS area_delta FROM c",
    "a5_change_summary": _CHANGES + " SELECT change, count(*) AS n, round(sum(d), 4) AS area FROM c GROUP BY 1",
    "a25_calibration": _SCORED + " SELECT floor(score * 10)::BIGINT AS bin, count(*) AS n, round(avg(score), 6) AS confidence, round(avg(label), 6) AS accuracy FROM scored WHERE label >= 0 AND score < 1 GROUP BY 1",
    "m13_groups": _SCORED.replace("WITH ", "WITH RECURSIVE ", 1) + """,
e AS (SELECT 'l:' || l_fid AS a, 'r:' || r_fid AS b, l_area, r_area FROM scored WHERE score >= 0.35 AND iou > 0),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT a AS node, a AS root FROM d UNION SELECT d.b, t.root FROM t JOIN d ON d.a = t.node),
comp AS (SELECT node, min(root) AS component FROM t GROUP BY 1),
ends AS (SELECT a AS node, l_area AS area FROM e UNION SELECT b, r_area FROM e),
z AS (SELECT component, count(*) FILTER (WHERE node LIKE 'l:%') AS n_left, count(*) FILTER (WHERE node LIKE 'r:%') AS n_right, sum(area) FILTER (WHERE node LIKE 'l:%') AS la, sum(area) FILTER (WHERE node LIKE 'r:%') AS ra FROM ends JOIN comp USING (node) GROUP BY 1)
SELECT component, n_left, n_right, CASE WHEN n_left = 1 AND n_right = 1 THEN '1:1' WHEN n_left = 1 THEN '1:N' WHEN n_right = 1 THEN 'N:1' ELSE 'N:M' END AS cardinality, abs(la - ra) / greatest(la, ra) <= 0.25 AS conserved FROM z""",
}
