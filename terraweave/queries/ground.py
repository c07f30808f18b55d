"""Overlays, shapes, repair and sketches of the polygons of the land records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.functions import rings as R
from terraweave.operators import overlay as O
from terraweave.operators.grid import box_join
from terraweave.session import durable, table

BUILDINGS = ["DRONE_BLDG", "CITY_BLDG", "ML_FOOT"]


def _ground(spark: SparkSession, sf_dir: str, *datasets: str) -> DataFrame:
    return O.ground_polygons(table(spark, sf_dir, "source_feature").where(F.col("dataset_id").isin(*datasets)))


def _thin(df: DataFrame) -> DataFrame:
    return df.select("fid", "dataset_id", "geom", "x1", "y1", "x2", "y2")


def g1_polygons(spark, sf_dir):
    """Measures of every polygon on the ground."""
    p = O.ground_polygons(table(spark, sf_dir, "source_feature"))
    origin = F.get(F.get("geom.rings", F.lit(0)), F.lit(0))
    near = R.shifted(F.get("geom.rings", F.lit(0)), -origin["x"], -origin["y"])
    return p.select("fid", F.round(O.polygon_area(F.col("geom")), 3).alias("area"), F.round(R.perimeter(near), 3).alias("perimeter"), F.size("geom.rings").cast("bigint").alias("rings"), F.round(R.compactness(near), 4).alias("compactness"), F.round(F.col("x2") - F.col("x1"), 3).alias("width"), F.round(F.col("y2") - F.col("y1"), 3).alias("height"))


def g4_overlay(spark, sf_dir):
    """What parcels of the two surveys share: area, intersection over union and containment."""
    pairs = O.overlay_join(_thin(_ground(spark, sf_dir, "SVR_CADASTRE")), _thin(_ground(spark, sf_dir, "COAST_PLOTS")), 0.01)
    return pairs.select("l_fid", "r_fid", F.round("shared", 2).alias("shared"), F.round(O.iou(), 4).alias("iou"), F.round(O.containment(), 4).alias("containment"))


def j1_accuracy(spark, sf_dir):
    """Candidates between the surveys within three declared deviations of both, the eight nearest by centre."""
    a, b = _thin(_ground(spark, sf_dir, "SVR_CADASTRE")), _thin(_ground(spark, sf_dir, "COAST_PLOTS"))
    sigma = table(spark, sf_dir, "source_dataset").select("dataset_id", F.coalesce("positional_accuracy_m", F.lit(5.0)).alias("s"))
    # Two datasets, so one row.
    radius = sigma.where(F.col("dataset_id").isin("SVR_CADASTRE", "COAST_PLOTS")).agg(F.greatest(F.lit(2.0), 3 * F.sqrt(F.sum(F.col("s") * F.col("s"))))).first()[0] or 2.0
    from terraweave.operators.grid import blocking_join

    pairs = blocking_join(a.drop("geom"), b.drop("geom"), float(radius))
    return pairs.select("l_fid", "r_fid", F.round("distance", 4).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def j3_polygons(spark, sf_dir):
    """Parcels of one survey that overlap by a quarter square metre or more."""
    p = _thin(O.ground_polygons(table(spark, sf_dir, "source_feature"), ["parcel"]))
    pairs = O.with_overlay(box_join(p, p).where("l_fid < r_fid AND l_dataset_id = r_dataset_id"))
    return pairs.where("shared >= 0.25").select("l_fid", "r_fid", F.round("shared", 2).alias("shared"))


def j5_polygons(spark, sf_dir):
    """Each building with the cadastral parcel that covers most of it."""
    out = O.largest_share(_thin(_ground(spark, sf_dir, *BUILDINGS)), _thin(_ground(spark, sf_dir, "SVR_CADASTRE")))
    return out.select("fid", "parent", F.round("covered", 2).alias("covered"), F.round("own_area", 2).alias("own_area"))


def j6_encroachment(spark, sf_dir):
    """Buildings that stand in a tank by four square metres or more, with a confidence."""
    out = O.largest_share(_thin(_ground(spark, sf_dir, *BUILDINGS)), _thin(_ground(spark, sf_dir, "TANK_WATER")), 0.0, 4.0).where("parent IS NOT NULL")
    share = F.col("covered") / F.col("own_area")
    return out.select("fid", "parent", F.round("covered", 2).alias("covered"), F.round(F.least(F.lit(0.95), 0.5 + 0.45 * share), 4).alias("confidence"))


_PROPOSED = (505600.0, 1220200.0, 505900.0, 1220420.0)


def j8_polygons(spark, sf_dir):
    """Parcels that a proposed rectangle takes from, by the share it takes, largest first."""
    x1, y1, x2, y2 = _PROPOSED
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    shape = F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])).alias("rings"))
    near = _thin(_ground(spark, sf_dir, "SVR_CADASTRE")).where((F.col("x1") <= x2) & (F.col("x2") >= x1) & (F.col("y1") <= y2) & (F.col("y2") >= y1))
    cut = O.with_overlay(near.withColumn("l_geom", F.col("geom")).withColumn("r_geom", shape)).where("shared > 0.01")
    return cut.select("fid", F.round("shared", 2).alias("shared"), F.round(F.col("shared") / F.col("area_l"), 4).alias("share"))


def j21_structures(spark, sf_dir):
    """Every cadastral parcel, with how many buildings meet it and how much they cover; none where there are none."""
    parcels = _thin(_ground(spark, sf_dir, "SVR_CADASTRE"))
    hits = O.overlay_join(parcels, _thin(_ground(spark, sf_dir, *BUILDINGS)), 0.01).groupBy(F.col("l_fid").alias("fid")).agg(F.count(F.lit(1)).alias("n"), F.sum("shared").alias("covered"))
    return parcels.select("fid").join(hits, "fid", "left").select("fid", F.coalesce("n", F.lit(0)).alias("n"), F.round("covered", 1).alias("covered"))


def g5_hausdorff(spark, sf_dir):
    """How far the boundaries of overlapping parcels of the two surveys lie apart."""
    pairs = O.overlay_join(_thin(_ground(spark, sf_dir, "SVR_CADASTRE")), _thin(_ground(spark, sf_dir, "COAST_PLOTS")), 0.01).where(O.iou() > 0.3)
    return O.with_shape_distances(pairs).select("l_fid", "r_fid", F.round("hausdorff", 3).alias("hausdorff"))


def m1_shapes(spark, sf_dir):
    """The shape features of overlapping buildings of two sources."""
    pairs = O.overlay_join(_thin(_ground(spark, sf_dir, "CITY_BLDG")), _thin(_ground(spark, sf_dir, "ML_FOOT")), 0.01).where(O.iou() > 0.1)
    return O.with_shape_distances(pairs).select("l_fid", "r_fid", *[F.round(c, 6).alias(c) for c in ("hausdorff", "boundary", "turning", "hu", "orientation", "elongation")])


def g10_rectangles(spark, sf_dir):
    """Least rectangle, hull and rectilinearity of every building."""
    s = O.with_shapes(_thin(_ground(spark, sf_dir, *BUILDINGS)))
    return s.select("fid", *[F.round(c, 3).alias(c) for c in ("hull_area", "long_side", "short_side", "direction", "rectilinear", "main")], "crossings")


def g12_regular(spark, sf_dir):
    """How the footprints of buildings are made regular, and the vertices that saves."""
    r = O.regularised(_thin(_ground(spark, sf_dir, "ML_FOOT", "DRONE_BLDG")))
    return r.groupBy("dataset_id", "method").agg(F.count(F.lit(1)).alias("n"), F.sum("vertices_before").alias("vertices_before"), F.sum("vertices_after").alias("vertices_after"), F.round(F.avg(O.polygon_area(F.col("regular")) / O.polygon_area(F.col("geom"))), 6).alias("area_ratio"))


def t1_polygons(spark, sf_dir):
    """How often each rule is broken by the polygons of each dataset."""
    p = O.ground_polygons(table(spark, sf_dir, "source_feature"))
    origin = F.get(F.get("geom.rings", F.lit(0)), F.lit(0))
    ring = R.shifted(F.get("geom.rings", F.lit(0)), -origin["x"], -origin["y"])
    return p.select("dataset_id", F.explode(R.violations(ring)).alias("rule")).groupBy("dataset_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def t3_repairs(spark, sf_dir):
    """What repair does to the polygons of each dataset, and how their area changes."""
    p = _thin(O.ground_polygons(table(spark, sf_dir, "source_feature"))).withColumn("before", O.polygon_area(F.col("geom")))
    r = O.repaired(p).withColumn("after", O.polygon_area(F.col("geom")))
    return r.groupBy("dataset_id", F.concat_ws("+", "actions").alias("actions")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs(F.col("after") - F.col("before"))), 1).alias("area_change"))


def t3_snaps(spark, sf_dir):
    """The vertices of cadastral parcels that move onto a neighbour's vertex, and how far."""
    moves = O.snap_moves(_thin(_ground(spark, sf_dir, "SVR_CADASTRE")), 0.5)
    return moves.select("fid", F.col("ring").cast("bigint").alias("ring"), F.col("nth").cast("bigint").alias("nth"), F.round("distance", 4).alias("distance"))


def t3_snapped(spark, sf_dir):
    """Overlaps of cadastral parcels before and after snapping."""
    p = _thin(_ground(spark, sf_dir, "SVR_CADASTRE"))
    s = durable(O.snapped(p, 0.5).select("fid", "dataset_id", "geom", O.envelope(F.col("geom")).alias("_b")).select("fid", "dataset_id", "geom", "_b.*"))
    total = lambda layer, name: O.with_overlay(box_join(layer, layer).where("l_fid < r_fid")).agg(F.lit(name).alias("state"), F.count_if(F.col("shared") >= 0.25).alias("overlaps"), F.round(F.sum("shared"), 1).alias("shared"))
    return total(p, "before").unionByName(total(s, "after"))


def g22_sketch(spark, sf_dir):
    """Base line, and chainage, offset and side of every vertex of the cadastral parcels."""
    p = _ground(spark, sf_dir, "SVR_CADASTRE").select("fid", O.field_sketch(F.get("geom.rings", F.lit(0))).alias("s"))
    return p.select("fid", F.round("s.base_line", 3).alias("base_line"), F.explode("s.stations").alias("v")).select("fid", "base_line", F.col("v.nth").cast("bigint").alias("nth"), F.round("v.chainage", 2).alias("chainage"), F.round("v.offset", 2).alias("offset"), "v.side")


QUERIES = {
    "g1_polygons": g1_polygons, "g4_overlay": g4_overlay, "g5_hausdorff": g5_hausdorff, "g10_rectangles": g10_rectangles, "g12_regular": g12_regular, "g22_sketch": g22_sketch,
    "j1_accuracy": j1_accuracy, "j3_polygons": j3_polygons, "j5_polygons": j5_polygons, "j6_encroachment": j6_encroachment, "j8_polygons": j8_polygons, "j21_structures": j21_structures,
    "m1_shapes": m1_shapes, "t1_polygons": t1_polygons, "t3_repairs": t3_repairs, "t3_snaps": t3_snaps, "t3_snapped": t3_snapped,
}

GROUND = """ground AS (
  SELECT * FROM (SELECT id AS fid, dataset_id, feature_class, properties, geom_metric AS geom, geom_metric.rings AS rings,
    list_min([p.x FOR p IN flatten(geom_metric.rings)]) AS x1, list_min([p.y FOR p IN flatten(geom_metric.rings)]) AS y1, list_max([p.x FOR p IN flatten(geom_metric.rings)]) AS x2, list_max([p.y FOR p IN flatten(geom_metric.rings)]) AS y2,
    row_number() OVER (PARTITION BY dataset_id, source_feature_id ORDER BY id) AS rn FROM source_feature)
  WHERE rn = 1 AND lower(geom.kind) = 'polygon' AND x1 >= 400000 AND x2 <= 800000 AND y1 >= 1100000 AND y2 <= 1500000 AND list_min([len(r) FOR r IN rings]) >= 4
), sides AS (SELECT fid, dataset_id, ring, r[1].x AS ox, r[1].y AS oy, unnest(range(1, len(r))) AS i, r FROM (SELECT fid, dataset_id, unnest(range(1, len(rings) + 1)) AS ring, rings FROM ground) AS g, LATERAL (SELECT g.rings[g.ring] AS r)
), edges AS (SELECT fid, dataset_id, ring, i, r[i].x AS ux, r[i].y AS uy, r[i + 1].x AS vx, r[i + 1].y AS vy, ox, oy FROM sides
), sizes AS (SELECT fid, 2 * max(a) FILTER (WHERE ring = 1) - sum(a) AS area, max(p) FILTER (WHERE ring = 1) AS perimeter, max(s) FILTER (WHERE ring = 1) AS outer_area, max(w) FILTER (WHERE ring = 1) AS signed_area FROM (
  SELECT fid, ring, abs(sum((ux - ox) * (vy - oy) - (vx - ox) * (uy - oy))) / 2 AS a, sum((ux - ox) * (vy - oy) - (vx - ox) * (uy - oy)) / 2 AS w, abs(sum((ux - ox) * (vy - oy) - (vx - ox) * (uy - oy))) / 2 AS s, sum(sqrt(pow(vx - ux, 2) + pow(vy - uy, 2))) AS p FROM edges GROUP BY 1, 2) GROUP BY 1)"""


def overlay_sql(pairs: str) -> str:
    """CTEs that end in ov(l_fid, r_fid, shared): what each of ``pairs`` (a query giving l_fid, r_fid) shares, by slabs."""
    return f"""pairs AS ({pairs}
), pe AS (
  SELECT l_fid, r_fid, side, CASE WHEN ux <= vx THEN ux ELSE vx END - x0 AS ux, CASE WHEN ux <= vx THEN uy ELSE vy END - y0 AS uy, CASE WHEN ux <= vx THEN vx ELSE ux END - x0 AS vx, CASE WHEN ux <= vx THEN vy ELSE uy END - y0 AS vy, row_number() OVER () AS k FROM (
    SELECT p.l_fid, p.r_fid, 0 AS side, e.*, g.x1 AS x0, g.y1 AS y0 FROM pairs AS p JOIN edges AS e ON e.fid = p.l_fid JOIN ground AS g ON g.fid = p.l_fid
    UNION ALL SELECT p.l_fid, p.r_fid, 1, e.*, g.x1, g.y1 FROM pairs AS p JOIN edges AS e ON e.fid = p.r_fid JOIN ground AS g ON g.fid = p.l_fid)
), cx AS (
  SELECT l_fid, r_fid, ux AS x FROM pe UNION SELECT l_fid, r_fid, vx FROM pe
  UNION SELECT l_fid, r_fid, ux + t * (vx - ux) FROM (
    SELECT a.*, ((b.ux - a.ux) * (b.vy - b.uy) - (b.uy - a.uy) * (b.vx - b.ux)) / d AS t, ((b.ux - a.ux) * (a.vy - a.uy) - (b.uy - a.uy) * (a.vx - a.ux)) / d AS u
    FROM (SELECT * FROM pe) AS a JOIN pe AS b ON a.l_fid = b.l_fid AND a.r_fid = b.r_fid AND a.k < b.k, LATERAL (SELECT (a.vx - a.ux) * (b.vy - b.uy) - (a.vy - a.uy) * (b.vx - b.ux) AS d) WHERE d <> 0) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1
), slabs AS (SELECT l_fid, r_fid, x, lead(x) OVER (PARTITION BY l_fid, r_fid ORDER BY x) AS nx FROM cx
), cuts AS (SELECT s.l_fid, s.r_fid, s.x, nx, side, e.uy + ((s.x + nx) / 2 - e.ux) * (e.vy - e.uy) / (e.vx - e.ux) AS y FROM slabs AS s JOIN pe AS e ON e.l_fid = s.l_fid AND e.r_fid = s.r_fid AND e.ux < (s.x + nx) / 2 AND e.vx > (s.x + nx) / 2 WHERE nx > s.x
), marks AS (SELECT *, lead(y) OVER w - y AS dy, sum(1 - side) OVER w AS na, sum(side) OVER w AS nb FROM cuts WINDOW w AS (PARTITION BY l_fid, r_fid, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), lens AS (SELECT *, lead(y) OVER (PARTITION BY l_fid, r_fid, x ORDER BY y) - y AS gap FROM marks
), ov AS (SELECT l_fid, r_fid, sum(gap * (nx - x)) AS shared FROM lens WHERE na % 2 = 1 AND nb % 2 = 1 GROUP BY 1, 2)"""


_BOXES = "l.x1 <= r.x2 AND l.x2 >= r.x1 AND l.y1 <= r.y2 AND l.y2 >= r.y1"
_BETWEEN = "SELECT l.fid AS l_fid, r.fid AS r_fid FROM ground AS l JOIN ground AS r ON l.dataset_id {l} AND r.dataset_id {r} AND " + _BOXES
_SURVEYS = overlay_sql(_BETWEEN.format(l="= 'SVR_CADASTRE'", r="= 'COAST_PLOTS'"))
_HOUSES = "IN ('DRONE_BLDG', 'CITY_BLDG', 'ML_FOOT')"
_RATED = ", q AS (SELECT l_fid, r_fid, shared, a.area AS la, b.area AS ra FROM ov JOIN sizes AS a ON a.fid = l_fid JOIN sizes AS b ON b.fid = r_fid)"
_X1, _Y1, _X2, _Y2 = _PROPOSED

ORACLES = {
    "g1_polygons": f"WITH {GROUND} SELECT fid, round(area, 3) AS area, round(perimeter, 3) AS perimeter, len(rings) AS rings, round(4 * 3.141592653589793 * outer_area / pow(perimeter, 2), 4) AS compactness, round(x2 - x1, 3) AS width, round(y2 - y1, 3) AS height FROM ground JOIN sizes USING (fid)",
    "g4_overlay": f"WITH {GROUND}, {_SURVEYS}{_RATED} SELECT l_fid, r_fid, round(shared, 2) AS shared, round(shared / (la + ra - shared), 4) AS iou, round(shared / least(la, ra), 4) AS containment FROM q WHERE shared > 0.01",
    "j1_accuracy": f"""WITH {GROUND}, s AS (SELECT greatest(2, 3 * sqrt(sum(pow(coalesce(positional_accuracy_m, 5), 2)))) AS r FROM source_dataset WHERE dataset_id IN ('SVR_CADASTRE', 'COAST_PLOTS')),
p AS (SELECT l.fid AS l_fid, q.fid AS r_fid, sqrt(pow((l.x1 + l.x2 - q.x1 - q.x2) / 2, 2) + pow((l.y1 + l.y2 - q.y1 - q.y2) / 2, 2)) AS d FROM ground AS l, ground AS q, s
  WHERE l.dataset_id = 'SVR_CADASTRE' AND q.dataset_id = 'COAST_PLOTS' AND q.x1 <= l.x2 + r AND q.x2 >= l.x1 - r AND q.y1 <= l.y2 + r AND q.y2 >= l.y1 - r AND (q.x2 - q.x1) * (q.y2 - q.y1) / ((l.x2 - l.x1) * (l.y2 - l.y1)) BETWEEN 0.08 AND 12),
n AS (SELECT *, row_number() OVER (PARTITION BY l_fid ORDER BY d, r_fid) AS rank FROM p) SELECT l_fid, r_fid, round(d, 4) AS distance, rank FROM n WHERE rank <= 8""",
    "j3_polygons": f"WITH {GROUND}, " + overlay_sql(f"SELECT l.fid AS l_fid, r.fid AS r_fid FROM ground AS l JOIN ground AS r ON l.dataset_id = r.dataset_id AND l.fid < r.fid AND l.feature_class = 'parcel' AND {_BOXES}") + " SELECT l_fid, r_fid, round(shared, 2) AS shared FROM ov WHERE shared >= 0.25",
    "j5_polygons": f"WITH {GROUND}, " + overlay_sql(_BETWEEN.format(l=_HOUSES, r="= 'SVR_CADASTRE'")) + f"""{_RATED}, b AS (SELECT l_fid, arg_min(r_fid, struct_pack(s := -shared, f := r_fid)) AS parent, max(shared) AS covered FROM q WHERE shared >= 0.25 * la GROUP BY 1)
SELECT g.fid, parent, round(coalesce(covered, 0), 2) AS covered, round(area, 2) AS own_area FROM ground AS g JOIN sizes USING (fid) LEFT JOIN b ON b.l_fid = g.fid WHERE dataset_id {_HOUSES}""",
    "j6_encroachment": f"WITH {GROUND}, " + overlay_sql(_BETWEEN.format(l=_HOUSES, r="= 'TANK_WATER'")) + f"{_RATED} SELECT l_fid AS fid, arg_min(r_fid, struct_pack(s := -shared, f := r_fid)) AS parent, round(max(shared), 2) AS covered, round(least(0.95, 0.5 + 0.45 * max(shared) / any_value(la)), 4) AS confidence FROM q WHERE shared >= 4 GROUP BY 1",
    "j8_polygons": f"""WITH {GROUND}, c AS (SELECT g.fid, e.*, g.x1 AS px1 FROM ground AS g JOIN edges AS e USING (fid) WHERE g.dataset_id = 'SVR_CADASTRE'),
k1 AS (SELECT fid, [{{'x': greatest(least(p.x, {_X2}), {_X1}), 'y': 0.0}} FOR p IN rings[1]] AS unused FROM ground),
hx AS (SELECT DISTINCT fid, x FROM (SELECT fid, ux AS x FROM c UNION SELECT fid, {_X1} FROM c UNION SELECT fid, {_X2} FROM c UNION SELECT fid, ux + (yy - uy) / (vy - uy) * (vx - ux) FROM c, (VALUES ({_Y1}), ({_Y2})) AS v(yy) WHERE vy <> uy AND (yy - uy) / (vy - uy) BETWEEN 0 AND 1)),
sl AS (SELECT fid, x, lead(x) OVER (PARTITION BY fid ORDER BY x) AS nx FROM hx), ins AS (SELECT * FROM sl WHERE nx > x AND (x + nx) / 2 BETWEEN {_X1} AND {_X2}),
yc AS (SELECT i.fid, i.x, i.nx, c.uy + ((i.x + i.nx) / 2 - c.ux) * (c.vy - c.uy) / (c.vx - c.ux) AS y FROM ins AS i JOIN c ON c.fid = i.fid AND least(c.ux, c.vx) < (i.x + i.nx) / 2 AND greatest(c.ux, c.vx) > (i.x + i.nx) / 2),
o AS (SELECT *, row_number() OVER (PARTITION BY fid, x ORDER BY y) AS k, lead(y) OVER (PARTITION BY fid, x ORDER BY y) AS ny FROM yc),
t AS (SELECT fid, sum(greatest(0, least(ny, {_Y2}) - greatest(y, {_Y1})) * (nx - x)) AS shared FROM o WHERE k % 2 = 1 GROUP BY 1)
SELECT t.fid, round(shared, 2) AS shared, round(shared / area, 4) AS share FROM t JOIN sizes USING (fid) WHERE shared > 0.01""",
    "j21_structures": f"WITH {GROUND}, " + overlay_sql(_BETWEEN.format(l="= 'SVR_CADASTRE'", r=_HOUSES)) + " SELECT g.fid, count(ov.r_fid) AS n, round(sum(shared), 1) AS covered FROM ground AS g LEFT JOIN ov ON ov.l_fid = g.fid AND shared > 0.01 WHERE g.dataset_id = 'SVR_CADASTRE' GROUP BY 1",
    "g5_hausdorff": f"""WITH {GROUND}, {_SURVEYS}{_RATED}, w AS (SELECT l_fid, r_fid FROM q WHERE shared > 0.01 AND shared / (la + ra - shared) > 0.3),
both_ AS (SELECT l_fid, r_fid, l_fid AS a, r_fid AS b FROM w UNION ALL SELECT l_fid, r_fid, r_fid, l_fid FROM w),
d AS (SELECT l_fid, r_fid, a, v.i, min(sqrt(pow(v.ux - e.ux - t * (e.vx - e.ux), 2) + pow(v.uy - e.uy - t * (e.vy - e.uy), 2))) AS d FROM both_ JOIN edges AS v ON v.fid = a AND v.ring = 1 JOIN edges AS e ON e.fid = b AND e.ring = 1,
  LATERAL (SELECT greatest(0, least(1, ((v.ux - e.ux) * (e.vx - e.ux) + (v.uy - e.uy) * (e.vy - e.uy)) / greatest(pow(e.vx - e.ux, 2) + pow(e.vy - e.uy, 2), 1e-300))) AS t) GROUP BY 1, 2, 3, 4)
SELECT l_fid, r_fid, round(max(d), 3) AS hausdorff FROM d GROUP BY 1, 2""",
    "t3_snaps": f"""WITH {GROUND}, v AS (SELECT fid, ring - 1 AS ring, i - 1 AS nth, ux AS x, uy AS y FROM edges WHERE dataset_id = 'SVR_CADASTRE'),
p AS (SELECT a.fid, a.ring, a.nth, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM v AS a JOIN v AS b ON b.fid < a.fid AND b.x BETWEEN a.x - 0.5 AND a.x + 0.5 AND b.y BETWEEN a.y - 0.5 AND a.y + 0.5)
SELECT fid, ring, nth, round(min(d), 4) AS distance FROM p WHERE d > 0 AND d <= 0.5 GROUP BY 1, 2, 3""",
    "g22_sketch": f"""WITH {GROUND}, v AS (SELECT fid, i - 1 AS nth, ux AS x, uy AS y FROM edges WHERE ring = 1 AND dataset_id = 'SVR_CADASTRE'),
b AS (SELECT DISTINCT ON (fid) * FROM (SELECT a.fid, a.nth AS i, b.nth AS j, a.x, a.y, b.x AS x2, b.y AS y2, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9) AS l FROM v AS a JOIN v AS b ON a.fid = b.fid AND a.nth < b.nth) ORDER BY fid, l DESC, i, j),
s AS (SELECT v.fid, l, nth, (v.x - b.x) * (x2 - b.x) / l + (v.y - b.y) * (y2 - b.y) / l AS c, (v.x - b.x) * (y2 - b.y) / l - (v.y - b.y) * (x2 - b.x) / l AS o FROM v JOIN b USING (fid))
SELECT fid, round(l, 3) AS base_line, nth, round(c, 2) AS chainage, round(abs(o), 2) AS "offset", CASE WHEN abs(o) < 1e-6 THEN 'on' WHEN o > 0 THEN 'right' ELSE 'left' END AS side FROM s""",
}
