"""Scalar functions, ring measures and ledgers over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.functions import geodesy as G
from terraweave.functions import identifiers as I
from terraweave.functions import names as N
from terraweave.functions import rings as R
from terraweave.functions import values as V
from terraweave.operators import ledger
from terraweave.plans.layers import layer, with_layers
from terraweave.session import table

_LON = "80.0 + CAST(p_partkey % 997 AS DOUBLE) / 100"
_LAT = "8.0 + CAST(p_partkey % 491 AS DOUBLE) / 100"
_NUMBER = "CAST(p_partkey % 500 AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN '/' WHEN 1 THEN ' / ' WHEN 2 THEN '-' ELSE '.' END || CAST(p_partkey % 7 + 1 AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE '' END"


def f1_survey_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_NUMBER.replace('VARCHAR', 'STRING')} AS raw")
    return p.select("p_partkey", V.survey_normal_form(V.squeezed(F.col("raw"))).alias("number"))


def f2_siblings(spark, sf_dir):
    """How many other subdivisions each parent number has."""
    n = f1_survey_numbers(spark, sf_dir)
    return n.groupBy(I.parent_number(F.col("number")).alias("parent")).agg(F.countDistinct("number").alias("subdivisions"), F.count(F.lit(1)).alias("n"))


def f14_fingerprints(spark, sf_dir):
    n = table(spark, sf_dir, "customer")
    return n.select("c_custkey", I.fingerprint(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("fingerprint"))


def f20_haversine(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_LON} AS lon", f"{_LAT} AS lat")
    return p.select("p_partkey", F.round(G.haversine(F.col("lon"), F.col("lat"), F.lit(80.25), F.lit(13.08)), 3).alias("metres"))


def f26_ecef(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_LON} AS lon", f"{_LAT} AS lat", "CAST(p_size AS DOUBLE) AS h")
    x, y, z = G.to_ecef(F.col("lon"), F.col("lat"), F.col("h"))
    return p.select("p_partkey", *[F.round(c, 3).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])


def _ring(df):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return df.withColumn("ring", F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1")))


def g1_measures(spark, sf_dir):
    p = _ring(layer(spark, sf_dir, "parcels_a"))
    r = F.col("ring")
    cx, cy = R.centroid(r)
    return p.select("fid", F.round(R.area(r), 6).alias("area"), F.round(R.perimeter(r), 6).alias("perimeter"), F.round(R.compactness(r), 6).alias("compactness"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


def t1_rules(spark, sf_dir):
    """How often each ring rule is broken by the sides of buildings, drawn clockwise every third time."""
    b = _ring(layer(spark, sf_dir, "buildings")).withColumn("ring", F.when(F.col("fid") % 3 == 0, F.reverse("ring")).otherwise(F.col("ring")))
    return b.select(F.explode(R.violations(F.col("ring"), 40.0)).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def l2_ledger(spark, sf_dir):
    """Every customer's row chained by hashes, and whether the chain holds."""
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("index"), F.concat_ws("|", "c_name", "c_nationkey").alias("payload"))
    return ledger.verified(ledger.chained(n)).select("index", "entry_hash", "holds")


def l3_merkle(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("index"), F.sha2(F.col("s_name"), 256).alias("hash"))
    return ledger.merkle_root(s)


def f8_name_similarity(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.round(N.jaro_winkler(F.lower("s_name"), F.lower("n_name")), 6).alias("similarity"))


def a29_rollup(spark, sf_dir):
    """Balances rolled up over region, nation and segment."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    out = j.rollup("r_name", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.grouping_id().alias("level"))
    return out.select("r_name", "n_name", "c_mktsegment", "n", "balance", F.col("level").cast("bigint").alias("level"))


def j11_within_distance(spark, sf_dir):
    """Buildings whose centres lie at most 18 metres apart, by the latitude sweep."""
    from terraweave.operators.proximity import near_and_within

    b = layer(spark, sf_dir, "buildings").select(F.col("fid").alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return near_and_within(b, None, 18.0).select("id_a", "id_b", F.round("distance", 6).alias("distance"))


def w1_frames(spark, sf_dir):
    """Running and neighbouring values of each customer's orders."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.row_number().over(w).cast("bigint").alias("nth"), F.lag("o_orderkey").over(w).alias("before"), F.ntile(4).over(w).cast("bigint").alias("quarter"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("mean_of_three"))


QUERIES = {
    "f8_name_similarity": f8_name_similarity, "a29_rollup": a29_rollup, "j11_within_distance": j11_within_distance, "w1_frames": w1_frames,
    "f1_survey_numbers": f1_survey_numbers, "f2_siblings": f2_siblings, "f14_fingerprints": f14_fingerprints,
    "f20_haversine": f20_haversine, "f26_ecef": f26_ecef, "g1_measures": g1_measures, "t1_rules": t1_rules, "l2_ledger": l2_ledger, "l3_merkle": l3_merkle,
}

_NUMBERS = f"""WITH r AS (SELECT p_partkey, {_NUMBER} AS raw FROM part),
n AS (SELECT p_partkey, regexp_replace(upper(regexp_replace(regexp_replace(raw, '\\s', '', 'g'), '[./-]+', '/', 'g')), '^0+([0-9])', '\\1') AS number FROM r)"""
_PHI = "radians(lat)"

ORACLES = {
    "f8_name_similarity": "SELECT s_suppkey, round(jaro_winkler_similarity(lower(s_name), lower(n_name)), 6) AS similarity FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "a29_rollup": """SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, grouping(r_name, n_name, c_mktsegment) AS level
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
    "j11_within_distance": with_layers("buildings") + """, c AS (SELECT fid, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM buildings)
SELECT a.fid AS id_a, b.fid AS id_b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM c AS a JOIN c AS b ON a.fid < b.fid AND b.x BETWEEN a.x - 18 AND a.x + 18 AND b.y BETWEEN a.y - 18 AND a.y + 18 WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 18""",
    "w1_frames": """SELECT o_orderkey, row_number() OVER w AS nth, lag(o_orderkey) OVER w AS before, ntile(4) OVER w AS quarter, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean_of_three FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "f1_survey_numbers": _NUMBERS + " SELECT p_partkey, number FROM n",
    "f2_siblings": _NUMBERS + " SELECT split_part(number, '/', 1) AS parent, count(DISTINCT number) AS subdivisions, count(*) AS n FROM n GROUP BY 1",
    "f14_fingerprints": "SELECT c_custkey, substr(sha256('=' || c_name || '|=' || c_mktsegment || '|=' || c_nationkey), 1, 16) AS fingerprint FROM customer",
    "f20_haversine": f"""WITH p AS (SELECT p_partkey, {_LON} AS lon, {_LAT} AS lat FROM part)
SELECT p_partkey, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(13.08 - lat) / 2), 2) + cos({_PHI}) * cos(radians(13.08)) * pow(sin(radians(80.25 - lon) / 2), 2))), 3) AS metres FROM p""",
    "f26_ecef": f"""WITH p AS (SELECT p_partkey, {_LON} AS lon, {_LAT} AS lat, p_size::DOUBLE AS h FROM part), e AS (SELECT 1 / 298.257223563 * (2 - 1 / 298.257223563) AS e2),
n AS (SELECT *, 6378137.0 / sqrt(1 - e2 * pow(sin({_PHI}), 2)) AS n FROM p, e)
SELECT p_partkey, round((n + h) * cos({_PHI}) * cos(radians(lon)), 3) AS x, round((n + h) * cos({_PHI}) * sin(radians(lon)), 3) AS y, round((n * (1 - e2) + h) * sin({_PHI}), 3) AS z FROM n""",
    "g1_measures": with_layers("parcels_a") + """ SELECT fid, round((x2 - x1) * (y2 - y1), 6) AS area, round(2 * (x2 - x1 + y2 - y1), 6) AS perimeter,
  round(4 * 3.141592653589793 * (x2 - x1) * (y2 - y1) / pow(2 * (x2 - x1 + y2 - y1), 2), 6) AS compactness, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy FROM parcels_a""",
    "t1_rules": with_layers("buildings") + """ SELECT 'clockwise' AS rule, count(*) AS n FROM buildings WHERE fid % 3 = 0
UNION ALL SELECT 'micro_area', count(*) FROM buildings WHERE (x2 - x1) * (y2 - y1) < 40 HAVING count(*) > 0""",
    "l3_merkle": """
WITH RECURSIVE t AS (SELECT 0 AS d, s_suppkey - min(s_suppkey) OVER () AS i, sha256(sha256(s_name)) AS x, sha256(s_name) AS h FROM supplier
UNION ALL SELECT d + 1, i // 2, '', sha256(arg_min(h, i) || arg_max(h, i)) FROM (SELECT *, count(*) OVER () AS n FROM t) WHERE n > 1 GROUP BY d + 1, i // 2)
SELECT arg_max(h, d) AS root FROM t""",
    "l2_ledger": """
WITH RECURSIVE n AS (SELECT c_custkey AS i, c_name || '|' || c_nationkey AS payload FROM customer),
c AS (SELECT i, sha256(i || '|' || payload || '|' || repeat('0', 64)) AS h FROM n WHERE i = (SELECT min(i) FROM n)
UNION ALL SELECT n.i, sha256(n.i || '|' || n.payload || '|' || c.h) FROM c JOIN n ON n.i = c.i + 1)
SELECT i::BIGINT AS "index", h AS entry_hash, true AS holds FROM c""",
}
