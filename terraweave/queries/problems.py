"""Queries for the general problems on the land records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.functions.ground import add_place, first_rows
from terraweave.operators.eav import eav_to_wide, wide_cells
from terraweave.operators.profile import control_limits, departures, long_values, merged_states, profile_loads, profile_of, profile_states
from terraweave.operators.proximity import near_and_within
from terraweave.operators.schema import crosswalk
from terraweave.session import durable, table

FEATURE = ["dataset_id", "source_feature_id"]
POINT_CLASSES = ["utility_node", "control_point"]
REGION_CLASSES = ["admin_unit", "water_body"]
NEAR_M = 12.0


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street points near each other, and the wards and tanks around them."""
    f = table(spark, sf_dir, "source_feature")
    is_point, is_region = F.col("feature_class").isin(POINT_CLASSES), F.col("feature_class").isin(REGION_CLASSES)
    rows = f.select(*FEATURE, "id", *[F.when(is_point, F.col(c)).alias(c) for c in ("geom_metric", "geom")], F.when(is_region, F.col("geom_metric")).alias("region"))
    placed = add_place(rows, "geom_metric", "geom", "x", "y").select(*FEATURE, "id", "x", "y", "region")
    first = durable(first_rows(placed, FEATURE, "id", ["x", "y", "region"]).where("x is not null or region is not null").select("id", "x", "y", "region"))
    points = first.where("x is not null").select("id", "x", "y")
    regions = first.where("region is not null").select("id", F.col("region").alias("geom"))
    return near_and_within(points, regions, NEAR_M).select("id_a", "id_b", "relation")


def p3_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per feature with a typed column for each canonical field."""
    return eav_to_wide(table(spark, sf_dir, "source_claim"), table(spark, sf_dir, "canonical_field"), FEATURE)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled cells of the wide table."""
    return wide_cells(p3_wide(spark, sf_dir), FEATURE)


LOAD = ["dataset_id", "run_id"]


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every attribute of every load."""
    wide = profile_loads(table(spark, sf_dir, "source_feature"), table(spark, sf_dir, "dataset_profile"), LOAD)
    return _shown(wide)


def _shown(profiled: DataFrame) -> DataFrame:
    return profiled.select(*LOAD, "attribute", "rows", "values", F.round("null_rate", 9).alias("null_rate"), "n_distinct", F.round("pattern_share", 9).alias("pattern_share"), "digits", "least", "most")


def p6_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every load, merged from stored states of the days on which its rows came in."""
    profile = table(spark, sf_dir, "dataset_profile")
    features = table(spark, sf_dir, "source_feature").withColumn("day", F.to_date("ingested_at"))
    days = durable(profile_states(features, profile, [*LOAD, "day"]))
    return _shown(profile_of(durable(merged_states(days, [*LOAD, "attribute"])), profile, LOAD)).drop("n_distinct")


def p6_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, matches and extremes of every attribute of every dataset, rolled up from the states of its loads."""
    loads = durable(profile_states(table(spark, sf_dir, "source_feature"), table(spark, sf_dir, "dataset_profile"), LOAD))
    whole = merged_states(loads, ["dataset_id", "attribute"]).where("attribute is not null")
    return whole.select("dataset_id", "attribute", F.col("n").alias("values"), "n_match", "numbers", "least", "most", "above", "below")


def p6_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null rate of every attribute of every load against control limits of the dataset's earlier loads."""
    profiled = profile_loads(table(spark, sf_dir, "source_feature"), table(spark, sf_dir, "dataset_profile"), LOAD).where("null_rate is not null")
    out = control_limits(profiled, ["dataset_id", "attribute"], "run_id", "null_rate", least_history=2)
    return out.select(*LOAD, "attribute", F.round("null_rate", 6).alias("null_rate"), "history_n", F.round("history_mean", 6).alias("history_mean"), F.round("history_deviation", 6).alias("history_deviation"), "out_of_control")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a load departs from what its dataset looked like when it was accepted."""
    profile = table(spark, sf_dir, "dataset_profile")
    return departures(profile_loads(table(spark, sf_dir, "source_feature"), profile, LOAD), profile, LOAD)


def b1_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical field of every property key of every dataset."""
    values = long_values(table(spark, sf_dir, "source_feature"), ["dataset_id"])
    out = crosswalk(values, table(spark, sf_dir, "canonical_field"))
    return out.select("dataset_id", "attribute", "field_name", F.round("score", 6).alias("score"), "state")


QUERIES = {"b1_crosswalk": b1_crosswalk, "p6_merged": p6_merged, "p6_datasets": p6_datasets, "p6_control": p6_control, "p6_profile": p6_profile, "p6_found": p6_found, "p2_found": p2_found, "p3_wide": p3_wide, "p3_found": p3_found}
# The claims with their field and canonical value.
KEYED_SQL = r"""
WITH names AS (SELECT field_name, kind, dtype, value_domain, unnest(list_prepend(field_name, aliases)) AS alias FROM canonical_field
), spelled AS (SELECT DISTINCT field_name, kind, dtype, value_domain, lower(regexp_replace(alias, '[^a-zA-Z0-9]', '', 'g')) AS k FROM names
), said AS (
  SELECT c.id, dataset_id, source_feature_id, observed_on, s.*, trim(regexp_replace(value_text, '\s+', ' ', 'g')) AS t, value_num AS x
  FROM source_claim AS c JOIN spelled AS s ON s.k = lower(regexp_replace(regexp_extract(property_path, '[^.]*$'), '[^a-zA-Z0-9]', '', 'g'))
  WHERE dataset_id IS NOT NULL AND source_feature_id IS NOT NULL
), told AS (
  SELECT *, CASE WHEN lower(t) NOT IN ('', '-', '--', '?', 'na', 'n/a', 'nil', 'none', 'null', 'not known', '-1', '-1.0') THEN t
    WHEN x <> -1 AND NOT isnan(x) THEN CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END END AS v0 FROM said
), low AS (SELECT *, lower(translate(v0, '௦௧௨௩௪௫௬௭௮௯', '0123456789')) AS v FROM told WHERE v0 IS NOT NULL
), parts AS (
  SELECT *, regexp_extract(v, '(\d+)', 1) AS digits, regexp_extract(v, '([ivxl]+)$', 1) AS numeral, replace(v, ',', '') AS flat,
    regexp_replace(regexp_replace(regexp_replace(upper(v), '[-/.\\_\s–—]+', '/', 'g'), '^/*0*([0-9])', '\1'), '/+$', '') AS dense FROM low
), keyed AS (
  SELECT id, dataset_id, source_feature_id, field_name, observed_on, CASE
    WHEN dtype = 'int' THEN CASE WHEN digits <> '' THEN digits::BIGINT::VARCHAR WHEN numeral <> '' THEN list_position(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xii', 'xiii', 'xiv', 'xv', 'xvi', 'xvii', 'xviii', 'xix', 'xx', 'xxi', 'xxii', 'xxiii', 'xxiv', 'xxv', 'xxvi', 'xxvii', 'xxviii', 'xxix', 'xxx'], numeral)::VARCHAR END
    WHEN dtype = 'float' THEN round(regexp_extract(flat, '^([0-9.]+)', 1)::DOUBLE * CASE WHEN flat LIKE '%ha' THEN 10000 ELSE 1 END * 100)::BIGINT::VARCHAR
    WHEN dtype = 'bool' THEN CASE WHEN v IN ('1', 't', 'true', 'y', 'yes') THEN 'true' WHEN v IN ('0', 'f', 'false', 'n', 'no') THEN 'false' END
    WHEN value_domain IS NOT NULL THEN list_filter(value_domain, lambda d: replace(d, '_', '') = regexp_replace(v, '[^a-z]', '', 'g'))[1]
    WHEN kind = 'identity' THEN regexp_replace(CASE WHEN regexp_full_match(regexp_replace(dense, '([0-9])/([A-Z])', '\1\2', 'g'), '\d+[A-Z]{0,3}(/[0-9]+[A-Z]*)*') THEN regexp_replace(dense, '([0-9])/([A-Z])', '\1\2', 'g') END, '\s', '', 'g')
    ELSE nullif(regexp_extract(v, '^(\d+)(\.0+)?$', 1), '') END AS value_key FROM parts
)"""

_PROFILED = """
WITH loads AS (SELECT dataset_id, run_id, count(*) AS n_rows FROM source_feature GROUP BY 1, 2
), pairs AS (SELECT dataset_id, run_id, unnest(map_entries(properties)) AS kv FROM source_feature
), vals AS (SELECT dataset_id, run_id, kv.key AS attribute, kv.value AS v FROM pairs WHERE trim(kv.value) <> ''
), measured AS (
  SELECT v.dataset_id, v.run_id, v.attribute, count(*) AS n, count(DISTINCT v.v) AS d, sum(CASE WHEN p.value_pattern IS NOT NULL THEN regexp_full_match(v.v, p.value_pattern)::INT END) AS k,
    count(CASE WHEN p.value_median IS NOT NULL THEN try_cast(v.v AS DOUBLE) END) AS numbers, min(CASE WHEN p.value_median IS NOT NULL THEN try_cast(v.v AS DOUBLE) END) AS lo, max(CASE WHEN p.value_median IS NOT NULL THEN try_cast(v.v AS DOUBLE) END) AS hi,
    CASE WHEN count(CASE WHEN p.value_median IS NOT NULL THEN try_cast(v.v AS DOUBLE) END) > 0 THEN count_if(try_cast(v.v AS DOUBLE) > 2 * p.value_median) END AS above,
    CASE WHEN count(CASE WHEN p.value_median IS NOT NULL THEN try_cast(v.v AS DOUBLE) END) > 0 THEN count_if(try_cast(v.v AS DOUBLE) < p.value_median / 2) END AS below
  FROM vals AS v LEFT JOIN dataset_profile AS p ON p.dataset_id = v.dataset_id AND p.attribute = v.attribute GROUP BY 1, 2, 3
), points AS (SELECT dataset_id, run_id, unnest(flatten(geom.rings)) AS q FROM source_feature
), digits AS (
  SELECT dataset_id, run_id, max(greatest(length(split_part(q.x::VARCHAR, '.', 2)) * (q.x <> round(q.x))::INT, length(split_part(q.y::VARCHAR, '.', 2)) * (q.y <> round(q.y))::INT)) AS digits FROM points GROUP BY 1, 2
), wanted AS (SELECT l.dataset_id, l.run_id, p.attribute FROM loads AS l JOIN dataset_profile AS p USING (dataset_id) WHERE p.attribute IS NOT NULL UNION SELECT dataset_id, run_id, attribute FROM measured
), profiled AS (
  SELECT w.*, l.n_rows AS "rows", coalesce(m.n, 0) AS "values", CASE WHEN w.attribute <> 'geom' THEN round(1 - coalesce(m.n, 0) / l.n_rows, 9) END AS null_rate, m.d AS n_distinct, round(m.k / m.n, 9) AS pattern_share,
    CASE WHEN w.attribute = 'geom' THEN g.digits END AS digits, m.lo AS least, m.hi AS most
  FROM wanted AS w JOIN loads AS l USING (dataset_id, run_id) LEFT JOIN measured AS m USING (dataset_id, run_id, attribute) LEFT JOIN digits AS g USING (dataset_id, run_id)
)"""

ORACLES: dict[str, str] = {
    "p6_profile": _PROFILED + " SELECT * FROM profiled",
    "p6_merged": _PROFILED + " SELECT * EXCLUDE (n_distinct) FROM profiled",
    "p6_datasets": _PROFILED + " SELECT dataset_id, attribute, sum(n)::BIGINT AS \"values\", sum(k)::BIGINT AS n_match, sum(numbers)::BIGINT AS numbers, min(lo) AS least, max(hi) AS most, sum(above)::BIGINT AS above, sum(below)::BIGINT AS below FROM measured GROUP BY 1, 2",
    "p6_control": _PROFILED + """, h AS (SELECT *, 1 - "values" / "rows" AS r FROM profiled WHERE null_rate IS NOT NULL
), past AS (SELECT *, count(r) OVER w AS history_n, avg(r) OVER w AS m, stddev_samp(r) OVER w AS s FROM h WINDOW w AS (PARTITION BY dataset_id, attribute ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT dataset_id, run_id, attribute, round(r, 6) AS null_rate, history_n, round(m, 6) AS history_mean, round(s, 6) AS history_deviation, coalesce(history_n >= 2 AND abs(r - m) > 3 * s, false) AS out_of_control FROM past""",
    "p2_found": """
WITH rows AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, source_feature_id ORDER BY id) AS rn FROM source_feature
), first AS (
  SELECT id, feature_class, geom_metric, geom_metric.rings[1][1].x AS mx, geom_metric.rings[1][1].y AS my,
         CASE WHEN geom.rings[1][1].x > 50 THEN geom.rings[1][1].x ELSE geom.rings[1][1].y END AS lon,
         CASE WHEN geom.rings[1][1].x > 50 THEN geom.rings[1][1].y ELSE geom.rings[1][1].x END AS lat
  FROM rows WHERE rn = 1 AND feature_class IN ('utility_node', 'control_point', 'admin_unit', 'water_body')
), terms AS (
  SELECT *, radians(lon - 81) AS lam,
         sinh(atanh(sin(radians(lat))) - 0.0818191908426215 * atanh(0.0818191908426215 * sin(radians(lat)))) AS t
  FROM first WHERE feature_class IN ('utility_node', 'control_point')
), angles AS (
  SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM terms
), points AS (
  SELECT id,
    CASE WHEN mx BETWEEN 400000 AND 800000 AND my BETWEEN 1200000 AND 1400000 THEN mx
         WHEN lon BETWEEN 80.9 AND 82.5 AND lat BETWEEN 10.9 AND 12.5 THEN 500000 + 6364902.166165086 * (eta
           + 0.0008377318206244698 * cos(2 * xi) * sinh(2 * eta) + 7.608527773572309e-07 * cos(4 * xi) * sinh(4 * eta)
           + 1.1976455033294525e-09 * cos(6 * xi) * sinh(6 * eta) + 2.429170607201359e-12 * cos(8 * xi) * sinh(8 * eta)) END AS x,
    CASE WHEN mx BETWEEN 400000 AND 800000 AND my BETWEEN 1200000 AND 1400000 THEN my
         WHEN lon BETWEEN 80.9 AND 82.5 AND lat BETWEEN 10.9 AND 12.5 THEN 6364902.166165086 * (xi
           + 0.0008377318206244698 * sin(2 * xi) * cosh(2 * eta) + 7.608527773572309e-07 * sin(4 * xi) * cosh(4 * eta)
           + 1.1976455033294525e-09 * sin(6 * xi) * cosh(6 * eta) + 2.429170607201359e-12 * sin(8 * xi) * cosh(8 * eta)) END AS y
  FROM angles
), placed AS (SELECT * FROM points WHERE x IS NOT NULL), cells AS (
  SELECT p.id, x, y, floor(x / 12) AS cx, floor(y / 12) AS cy FROM placed AS p
), near AS (
  SELECT DISTINCT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b
  FROM (SELECT *, cx + dx AS nx, cy + dy AS ny FROM cells, (VALUES (-1), (0), (1)) AS i(dx), (VALUES (-1), (0), (1)) AS j(dy)) AS a
  JOIN cells AS b ON a.nx = b.cx AND a.ny = b.cy AND a.id < b.id
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 12
), rings AS (
  SELECT id, unnest(geom_metric.rings) AS ring FROM first WHERE feature_class IN ('admin_unit', 'water_body')
), sides AS (
  SELECT id, unnest(list_zip(ring[:-2], ring[2:])) AS side FROM rings
), edges AS (
  SELECT id, side[1].x AS x1, side[1].y AS y1, side[2].x AS x2, side[2].y AS y2 FROM sides
), inside AS (
  SELECT p.id AS pid, e.id AS rid FROM placed AS p JOIN edges AS e
    ON p.y >= least(e.y1, e.y2) AND p.y < greatest(e.y1, e.y2) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY 1, 2 HAVING count(*) % 2 = 1
)
SELECT id_a, id_b, 'near' AS relation FROM near
UNION ALL SELECT least(pid, rid), greatest(pid, rid), 'within' FROM inside""",
    "p3_found": KEYED_SQL + r"""
SELECT dataset_id, source_feature_id, field_name, value_key FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, source_feature_id, field_name ORDER BY observed_on DESC NULLS LAST, id) AS rn FROM keyed WHERE value_key IS NOT NULL) WHERE rn = 1""",
    "p6_found": """
WITH loads AS (
  SELECT dataset_id, run_id, count(*) AS n_rows FROM source_feature GROUP BY 1, 2 HAVING count(*) >= 20
), pairs AS (
  SELECT dataset_id, run_id, unnest(map_entries(properties)) AS kv FROM source_feature
), vals AS (
  SELECT dataset_id, run_id, kv.key AS attribute, kv.value AS v FROM pairs WHERE trim(kv.value) <> ''
), measured AS (
  SELECT v.dataset_id, v.run_id, v.attribute, count(*) AS n, count(DISTINCT v.v) AS d,
         avg(CASE WHEN p.value_pattern IS NOT NULL THEN regexp_full_match(v.v, p.value_pattern)::INT END) AS share,
         median(CASE WHEN p.value_median IS NOT NULL THEN try_cast(v.v AS DOUBLE) END) AS m
  FROM vals AS v JOIN dataset_profile AS p USING (dataset_id, attribute) GROUP BY 1, 2, 3
), points AS (
  SELECT dataset_id, run_id, unnest(flatten(geom.rings)) AS q FROM source_feature
), digits AS (
  SELECT dataset_id, run_id, max(greatest(length(split_part(q.x::VARCHAR, '.', 2)) * (q.x <> round(q.x))::INT, length(split_part(q.y::VARCHAR, '.', 2)) * (q.y <> round(q.y))::INT)) AS k
  FROM points GROUP BY 1, 2
), all_of AS (
  SELECT l.dataset_id, l.run_id, p.attribute, l.n_rows, coalesce(m.n, 0) AS n, m.d, m.share, m.m, g.k, p.*
  FROM loads AS l JOIN dataset_profile AS p ON l.dataset_id = p.dataset_id
  LEFT JOIN measured AS m ON m.dataset_id = l.dataset_id AND m.run_id = l.run_id AND m.attribute = p.attribute
  LEFT JOIN digits AS g ON g.dataset_id = l.dataset_id AND g.run_id = l.run_id
)
SELECT dataset_id, run_id, attribute, 'null_rate' AS measure FROM all_of WHERE attribute <> 'geom' AND abs(1 - n / n_rows - attribute_null_rate) > 0.25
UNION ALL SELECT dataset_id, run_id, attribute, 'cardinality' FROM all_of WHERE attribute <> 'geom' AND attribute_cardinality = feature_count AND d < 0.75 * n
UNION ALL SELECT dataset_id, run_id, attribute, 'pattern' FROM all_of WHERE attribute <> 'geom' AND pattern_share - share > 0.15
UNION ALL SELECT dataset_id, run_id, attribute, 'distribution' FROM all_of WHERE attribute <> 'geom' AND (m > 2 * value_median OR m < value_median / 2)
UNION ALL SELECT dataset_id, run_id, attribute, 'precision' FROM all_of WHERE attribute = 'geom' AND coordinate_precision_digits - k >= 2""",
}
