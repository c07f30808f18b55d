"""Layers of the land records linked, clustered and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.functions import values as V
from terraweave.operators import assignment as A
from terraweave.operators import linkage as L
from terraweave.operators import overlay as O
from terraweave.operators.graph import components
from terraweave.queries.ground import _HOUSES, _RATED, _SURVEYS, GROUND, _BOXES, overlay_sql
from terraweave.session import durable, table

SURVEYS = ("SVR_CADASTRE", "COAST_PLOTS")


def _layer(spark, sf_dir, *datasets):
    p = O.ground_polygons(table(spark, sf_dir, "source_feature").where(F.col("dataset_id").isin(*datasets)))
    number = V.survey_normal_form(V.squeezed(F.coalesce(F.col("properties")["survey_number"], F.col("properties")["Survey_Number"])))
    return durable(p.select("fid", "dataset_id", "geom", "x1", "y1", "x2", "y2", O.polygon_area(F.col("geom")).alias("area"), number.alias("number"), F.coalesce(F.col("properties")["lgd_village_code"], F.lit(None)).alias("village")))


def _pairs(a, b):
    """Overlapping pairs with their features."""
    o = O.overlay_join(a, b, 0.01)
    middle = lambda s, k: (F.col(f"{s}_{k}1") + F.col(f"{s}_{k}2")) / 2
    dx, dy = middle("r", "x") - middle("l", "x"), middle("r", "y") - middle("l", "y")
    radius = F.sqrt(F.least("area_l", "area_r") / 3.141592653589793)
    return o.select(
        "l_fid", "r_fid", "l_geom", "r_geom", "l_area", "r_area", "l_number", "r_number", "area_l", "area_r", "shared", O.iou().alias("iou"), O.containment().alias("containment"), (F.hypot(dx, dy) / radius).alias("dist_norm"), F.abs(F.log(F.col("area_r") / F.col("area_l"))).alias("log_area"),
        A.survey_agreement(F.col("l_number"), F.col("r_number")).alias("attr_number"), dx.alias("dx"), dy.alias("dy"), middle("l", "x").alias("lx"), middle("l", "y").alias("ly"),
    )


def _best(pairs, least):
    best = L.with_ranks(pairs).where("mutual").where(F.col("iou") >= least)
    return best


def _surveys(spark, sf_dir):
    a, b = (_layer(spark, sf_dir, d) for d in SURVEYS)
    return a, b, durable(_pairs(a, b))


def m2_attributes(spark, sf_dir):
    """How the survey numbers of overlapping parcels agree."""
    _, _, p = _surveys(spark, sf_dir)
    return p.groupBy("attr_number").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("iou"), 4).alias("mean_iou"))


def w3_context(spark, sf_dir):
    """How alike the displacements of overlapping parcels and their neighbours are."""
    _, _, p = _surveys(spark, sf_dir)
    return A.neighbour_agreement(p.select("l_fid", "r_fid", "lx", "ly", "dx", "dy")).select("l_fid", "r_fid", F.round("agreement", 4).alias("agreement"))


def m9_surveys(spark, sf_dir):
    """The fixed score of overlapping parcels with their shapes, and the links of greatest total score."""
    _, _, p = _surveys(spark, sf_dir)
    s = O.with_shape_distances(p)
    score = 0.34 * F.col("iou") + 0.16 * F.col("containment") + 0.18 * F.exp(-F.col("dist_norm") / 1.5) + 0.12 * (1 - F.col("turning") / 3) + 0.10 * F.exp(-F.col("log_area")) + 0.10 * F.col("attr_number")
    links = A.optimal_links(s.select("l_fid", "r_fid", score.alias("p")))
    return links.select("l_fid", "r_fid", F.round("p", 6).alias("p"), "state")


def a13_assignment(spark, sf_dir):
    """Accepted and flagged links between the surveys, and their mean score."""
    return m9_surveys(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.countDistinct("l_fid").alias("left_ids"), F.countDistinct("r_fid").alias("right_ids"))


def m7_learned(spark, sf_dir):
    """Links by a score learned from weak labels; the fixed score where labels are too few."""
    _, _, p = _surveys(spark, sf_dir)
    rated = durable(L.with_ranks(p.withColumn("attr_ward", F.col("attr_number")).withColumn("attr_use", F.col("attr_number"))).withColumn("label", L.weak_label(L.votes())))
    model = A.fit_matcher(rated, ["iou", "containment", "dist_norm", "log_area", "attr_number"])
    scored = A.predicted(model, rated) if model is not None else rated.withColumn("p", L.geometric_score())
    return A.optimal_links(scored.select("l_fid", "r_fid", "p")).select("l_fid", "r_fid", F.round("p", 6).alias("p"), "state")


def m16_events(spark, sf_dir):
    """What became of the cadastre's parcels in the other survey."""
    a, b, p = _surveys(spark, sf_dir)
    live = p.where("containment >= 0.35").select("l_fid", "r_fid", "l_area", "r_area")
    links = live.select(F.concat(F.lit("l:"), F.col("l_fid").cast("string")).alias("a"), F.concat(F.lit("r:"), F.col("r_fid").cast("string")).alias("b"))
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    return A.parcel_events(L.cardinality_groups(live, components(nodes, links)), a, b, live)


def m17_clusters(spark, sf_dir):
    """Buildings of three sources clustered where they cover each other by half or more."""
    h = _layer(spark, sf_dir, "DRONE_BLDG", "CITY_BLDG", "ML_FOOT")
    edges = O.overlay_join(h, h, 0.01).where("l_dataset_id < r_dataset_id").where(O.iou() >= 0.5).select(F.col("l_fid").alias("a"), F.col("r_fid").alias("b"))
    c = A.clusters(h.select("fid", "dataset_id"), durable(edges))
    return c.select("cluster", "members", "datasets", "sources", F.round("support", 6).alias("support"), "kind")


def a14_clusters(spark, sf_dir):
    """Clusters by their sources: number, mean support and members."""
    return m17_clusters(spark, sf_dir).groupBy("datasets", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("support"), 6).alias("support"), F.sum("members").alias("members"))


def _differences(spark, sf_dir, cross_source):
    a, b, p = _surveys(spark, sf_dir)
    links = _best(p, 0.35)
    from terraweave.operators.quantiles import exact_quantiles

    offset = exact_quantiles(links.where("iou >= 0.55"), mx=("dx", 0.5), my=("dy", 0.5))
    # One row against the links.
    moved = F.hypot(F.col("dx") - F.coalesce("mx", F.lit(0.0)), F.col("dy") - F.coalesce("my", F.lit(0.0)))
    rows = links.join(F.broadcast(offset)).select("l_fid", "r_fid", "l_area", "r_area", moved.alias("moved"), (F.col("attr_number") == 0).cast("int").alias("attributes"))
    d = A.typed_differences(rows, a.select("fid", "area"), b.select("fid", "area"), cross_source)
    return d.select("fid", "difference", F.round("area_delta", 2).alias("area_delta"), "actionable")


def x1_sources(spark, sf_dir):
    """Where the two surveys disagree: sources of one ground, so nothing is demolished."""
    return _differences(spark, sf_dir, True)


def x1_epochs(spark, sf_dir):
    """The same two surveys read as two epochs."""
    return _differences(spark, sf_dir, False)


def a6_changes(spark, sf_dir):
    """Counts of all differences beside those that call for action."""
    d = x1_epochs(spark, sf_dir)
    return d.groupBy("difference").agg(F.count(F.lit(1)).alias("n"), F.count_if("actionable").alias("actionable"), F.round(F.sum(F.greatest("area_delta", F.lit(0.0))), 0).alias("added"), F.round(F.sum(F.least("area_delta", F.lit(0.0))), 0).alias("removed"))


def x2_deltas(spark, sf_dir):
    """Survey numbers that differ between linked parcels of the two surveys."""
    _, _, p = _surveys(spark, sf_dir)
    told = lambda side: F.create_map(F.lit("number"), F.col(f"{side}_number"))
    d = _best(p, 0.35).select("l_fid", "r_fid", F.explode(A.attribute_deltas(told("l"), told("r"), ["number", "none"])).alias("key", "v"))
    return d.select("l_fid", "r_fid", "key", "v.before", "v.after")


QUERIES = {
    "m2_attributes": m2_attributes, "w3_context": w3_context, "m9_surveys": m9_surveys, "a13_assignment": a13_assignment, "m7_learned": m7_learned, "m16_events": m16_events, "m17_clusters": m17_clusters,
    "a14_clusters": a14_clusters, "x1_sources": x1_sources, "x1_epochs": x1_epochs, "a6_changes": a6_changes, "x2_deltas": x2_deltas,
}

_NUMBER = r"""CASE WHEN t IS NOT NULL THEN regexp_replace(CASE WHEN regexp_full_match(regexp_replace(d, '([0-9])/([A-Z])', '\1\2', 'g'), '\d+[A-Z]{0,3}(/[0-9]+[A-Z]*)*') THEN regexp_replace(d, '([0-9])/([A-Z])', '\1\2', 'g') END, '\s', '', 'g') END"""
_NUMBERS = rf"""numbers AS (SELECT fid, {_NUMBER} AS number FROM (SELECT fid, t, regexp_replace(regexp_replace(regexp_replace(upper(translate(t, '௦௧௨௩௪௫௬௭௮௯', '0123456789')), '[-/.\\_\s–—]+', '/', 'g'), '^/*0*([0-9])', '\1'), '/+$', '') AS d
  FROM (SELECT fid, coalesce(properties['survey_number'], properties['Survey_Number']) AS t FROM ground WHERE dataset_id IN ('SVR_CADASTRE', 'COAST_PLOTS'))))"""
_P = f"""{GROUND}, {_SURVEYS}{_RATED}, {_NUMBERS}, f AS (SELECT l_fid, r_fid, shared, la, ra, shared / (la + ra - shared) AS iou, shared / least(la, ra) AS containment, (b.x1 + b.x2 - a.x1 - a.x2) / 2 AS dx, (b.y1 + b.y2 - a.y1 - a.y2) / 2 AS dy, (a.x1 + a.x2) / 2 AS lx, (a.y1 + a.y2) / 2 AS ly,
  CASE WHEN m.number IS NULL OR n.number IS NULL THEN 0.5 WHEN m.number = n.number THEN 1 WHEN split_part(m.number, '/', 1) = split_part(n.number, '/', 1) THEN 0.35 ELSE 0 END AS attr
  FROM q JOIN ground AS a ON a.fid = l_fid JOIN ground AS b ON b.fid = r_fid JOIN numbers AS m ON m.fid = l_fid JOIN numbers AS n ON n.fid = r_fid WHERE shared > 0.01)"""
_DIFF = _P + """, k AS (SELECT *, row_number() OVER (PARTITION BY l_fid ORDER BY iou DESC, l_fid, r_fid) AS rl, row_number() OVER (PARTITION BY r_fid ORDER BY iou DESC, l_fid, r_fid) AS rr FROM f), links AS (SELECT * FROM k WHERE rl = 1 AND rr = 1 AND iou >= 0.35),
off AS (SELECT coalesce(median(dx), 0) AS mx, coalesce(median(dy), 0) AS my FROM links WHERE iou >= 0.55), g AS (SELECT *, ra - la AS d, (ra - la) / la AS e, sqrt(pow(dx - mx, 2) + pow(dy - my, 2)) AS moved FROM links, off),
c AS (SELECT l_fid AS fid, CASE WHEN ra <= 0.25 * la THEN 'demolition' WHEN e >= 0.08 AND d >= 6 THEN 'extension' WHEN e <= -0.08 AND d <= -6 THEN 'reduction' WHEN abs(e) < 0.08 AND moved > 0.75 THEN 'displacement' WHEN attr = 0 THEN 'attribute_change' ELSE 'no_change' END AS k, d FROM g
  UNION ALL SELECT fid, 'removed', -area FROM ground JOIN sizes USING (fid) WHERE dataset_id = 'SVR_CADASTRE' AND fid NOT IN (SELECT l_fid FROM links) UNION ALL SELECT fid, 'new', area FROM ground JOIN sizes USING (fid) WHERE dataset_id = 'COAST_PLOTS' AND fid NOT IN (SELECT r_fid FROM links)),
epochs AS (SELECT fid, k AS difference, round(d, 2) AS area_delta, k NOT IN ('no_change', 'displacement', 'attribute_change') AS actionable FROM c)"""

ORACLES = {
    "m2_attributes": f"WITH {_P} SELECT attr::DOUBLE AS attr_number, count(*) AS n, round(avg(iou), 4) AS mean_iou FROM f GROUP BY 1",
    "w3_context": f"""WITH {_P}, b AS (SELECT DISTINCT ON (l_fid) * FROM f ORDER BY l_fid, sqrt(dx * dx + dy * dy), r_fid)
SELECT f.l_fid, f.r_fid, round(coalesce(avg(exp(-sqrt(pow(b.dx - f.dx, 2) + pow(b.dy - f.dy, 2)) / 2)), 0.5), 4) AS agreement FROM f LEFT JOIN b ON b.l_fid <> f.l_fid AND b.lx BETWEEN f.lx - 60 AND f.lx + 60 AND b.ly BETWEEN f.ly - 60 AND f.ly + 60 GROUP BY 1, 2""",
    "m16_events": f"""WITH RECURSIVE {_P}, e AS (SELECT 'l:' || l_fid AS a, 'r:' || r_fid AS b, l_fid, r_fid, la, ra FROM f WHERE containment >= 0.35), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT a AS node, a AS root FROM d UNION SELECT d.b, t.root FROM t JOIN d ON d.a = t.node), comp AS (SELECT node, min(root) AS c FROM t GROUP BY 1), ends AS (SELECT a AS node, la AS area FROM e UNION SELECT b, ra FROM e),
z AS (SELECT c, count(*) FILTER (WHERE node LIKE 'l:%') AS nl, count(*) FILTER (WHERE node LIKE 'r:%') AS nr, sum(area) FILTER (WHERE node LIKE 'l:%') AS sl, sum(area) FILTER (WHERE node LIKE 'r:%') AS sr FROM ends JOIN comp USING (node) GROUP BY 1)
SELECT CASE WHEN nl = 1 AND nr = 1 THEN 'kept' WHEN nl = 1 THEN 'subdivision' WHEN nr = 1 THEN 'amalgamation' ELSE 'reorganisation' END AS event, count(*) AS n, count_if(abs(sl - sr) / greatest(sl, sr) <= 0.25) AS conserved FROM z GROUP BY 1
UNION ALL SELECT 'retired', count(*), 0 FROM ground WHERE dataset_id = 'SVR_CADASTRE' AND fid NOT IN (SELECT l_fid FROM e) UNION ALL SELECT 'new', count(*), 0 FROM ground WHERE dataset_id = 'COAST_PLOTS' AND fid NOT IN (SELECT r_fid FROM e)""",
    "x1_epochs": f"WITH {_DIFF} SELECT * FROM epochs",
    "x1_sources": f"""WITH {_DIFF} SELECT fid, CASE difference WHEN 'removed' THEN 'source_omission' WHEN 'new' THEN 'source_commission' WHEN 'displacement' THEN 'positional_disagreement' WHEN 'attribute_change' THEN 'attribute_disagreement' WHEN 'no_change' THEN 'agreement' ELSE 'geometric_disagreement' END AS difference, area_delta, actionable FROM epochs""",
    "a6_changes": f"WITH {_DIFF} SELECT difference, count(*) AS n, count_if(actionable) AS actionable, round(sum(greatest(area_delta, 0)), 0) AS added, round(sum(least(area_delta, 0)), 0) AS removed FROM epochs GROUP BY 1",
    "x2_deltas": f"WITH {_DIFF} SELECT l_fid, r_fid, 'number' AS key, m.number AS before, n.number AS after FROM links JOIN numbers AS m ON m.fid = l_fid JOIN numbers AS n ON n.fid = r_fid WHERE m.number <> n.number",
}
_CLUSTERED = f"WITH RECURSIVE {GROUND}, " + overlay_sql(f"SELECT l.fid AS l_fid, r.fid AS r_fid FROM ground AS l JOIN ground AS r ON l.dataset_id {_HOUSES} AND r.dataset_id {_HOUSES} AND l.dataset_id < r.dataset_id AND {_BOXES}") + f"""{_RATED}, e AS (SELECT l_fid AS a, r_fid AS b FROM q WHERE shared > 0.01 AND shared / (la + ra - shared) >= 0.5), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
h AS (SELECT fid, dataset_id FROM ground WHERE dataset_id {_HOUSES}), t AS (SELECT fid AS node, fid AS root FROM h UNION SELECT d.b, t.root FROM t JOIN d ON d.a = t.node), comp AS (SELECT node, min(root) AS cluster FROM t GROUP BY 1),
m AS (SELECT cluster, count(*) AS members, count(DISTINCT dataset_id) AS datasets, string_agg(DISTINCT dataset_id, ',' ORDER BY dataset_id) AS sources FROM h JOIN comp ON node = fid GROUP BY 1), n AS (SELECT cluster, count(*) AS n FROM e JOIN comp ON node = a GROUP BY 1),
cl AS (SELECT cluster, members, datasets, sources, CASE WHEN members > 1 THEN round(least(1, coalesce(n, 0) / (members * (members - 1) / 2)), 6) ELSE 0 END AS support, CASE WHEN members = 1 THEN 'single' WHEN members > datasets THEN 'N:M' ELSE '1:1' END AS kind FROM m LEFT JOIN n USING (cluster))"""
ORACLES["m17_clusters"] = _CLUSTERED + " SELECT * FROM cl"
ORACLES["a14_clusters"] = _CLUSTERED + " SELECT datasets, kind, count(*) AS n, round(avg(support), 6) AS support, sum(members)::BIGINT AS members FROM cl GROUP BY 1, 2"
