"""The claims of the land records weighed, fused, resolved and assembled."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.operators import measures as M
from terraweave.operators import resolution as R
from terraweave.queries import problems
from terraweave.session import durable, table

AS_OF = "2026-01-01"
# Weights of fields in completeness.
WEIGHTS = {"survey_number": 1.0, "village_lgd": 0.9, "extent_m2": 0.8, "land_use": 0.7, "ward": 0.6, "zone": 0.4, "floors": 0.4, "built_year": 0.3, "is_active": 0.3}


def _claims(spark, sf_dir):
    return R.field_claims(table(spark, sf_dir, "source_claim"), table(spark, sf_dir, "canonical_field"))


def _evidence(spark, sf_dir, discounted=True):
    return R.weighed(_claims(spark, sf_dir), table(spark, sf_dir, "source_dataset"), AS_OF, discounted)


def c1_claims(spark, sf_dir):
    """The mass of every source's claim about every field of every entity."""
    return _evidence(spark, sf_dir).select("entity_id", "field_name", "dataset_id", "value", "family", F.round("mass", 6).alias("mass"))


def c2_independence(spark, sf_dir):
    """What sources of one origin lose: mean mass of every dataset with and without the discount, and its origins."""
    plain = _evidence(spark, sf_dir, False).groupBy("dataset_id").agg(F.round(F.avg("mass"), 6).alias("alone"))
    less = _evidence(spark, sf_dir).groupBy("dataset_id").agg(F.round(F.avg("mass"), 6).alias("discounted"))
    return plain.join(less, "dataset_id").join(R.lineage_roots(table(spark, sf_dir, "source_dataset")), "dataset_id", "left")


def c6_claims(spark, sf_dir):
    """The decision about every field of every entity."""
    d = R.decided(durable(_evidence(spark, sf_dir)))
    return d.select("entity_id", "field_name", "value", "strategy", F.round("belief", 5).alias("belief"), F.round("plausibility", 5).alias("plausibility"), "options", "claims", "escalated")


def c8_strategies(spark, sf_dir):
    """How decisions come about, by field."""
    return c6_claims(spark, sf_dir).groupBy("field_name", "strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("belief"), 4).alias("mean_belief"), F.count_if("escalated").alias("escalated"))


def c11_queue(spark, sf_dir):
    """The open cases of every field by priority."""
    e = durable(_evidence(spark, sf_dir))
    q = R.queue(R.decided(e), e)
    return q.select("entity_id", "field_name", *[F.round(c, 6).alias(c) for c in ("severity", "uncertainty", "priority")], "batch")


def b2_records(spark, sf_dir):
    """One record of every entity from its decisions."""
    d = R.decided(durable(_evidence(spark, sf_dir)))
    return d.groupBy("entity_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in WEIGHTS], F.count(F.lit(1)).alias("decided"), F.round(F.min("belief"), 5).alias("least_belief"))


def b3_confidence(spark, sf_dir):
    """The confidence of every entity and its dimensions."""
    e = durable(_evidence(spark, sf_dir))
    c = R.fabric_confidence(R.decided(e), e, WEIGHTS, AS_OF).withColumn("confidence", M.composite())
    return c.select("entity_id", "n", *[F.round(x, 5).alias(x) for x in ("placement", "agreement", "completeness", "currency", "confidence")], M.grade(F.round("confidence", 9)).alias("grade"))


def a4_confidence_summary(spark, sf_dir):
    """Grades of all entities: number, mean confidence and dimensions, share that may be published."""
    c = b3_confidence(spark, sf_dir)
    return c.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(x), 4).alias(x) for x in ("confidence", "agreement", "completeness", "currency")])


def u4_distinct(spark, sf_dir):
    """The different values and sources of every field of every entity."""
    return _claims(spark, sf_dir).groupBy("entity_id", "field_name").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("values"), F.array_join(F.array_sort(F.collect_set("dataset_id")), "|").alias("sources"))


def z6_reliability(spark, sf_dir):
    """Prior, accuracy weight and half-life of every dataset in every family."""
    d = table(spark, sf_dir, "source_dataset").select("dataset_id", "source_type", "positional_accuracy_m", F.explode(F.array(*[F.lit(f) for f in R.FAMILIES])).alias("family"))
    from terraweave.operators import evidence as E

    return d.select("dataset_id", "family", R.prior(F.col("source_type"), F.col("family")).alias("prior"), F.round(E.accuracy_weight(F.coalesce("positional_accuracy_m", R.nominal_accuracy(F.col("source_type")))), 6).alias("accuracy"), R.half_life(F.col("source_type")).alias("half_life"), R.authority_rank(F.col("source_type"), F.col("family")).cast("bigint").alias("authority"))


def z15_registry(spark, sf_dir):
    """Datasets and features by type of source."""
    f = table(spark, sf_dir, "source_feature").groupBy("dataset_id").agg(F.countDistinct("source_feature_id").alias("n"))
    d = table(spark, sf_dir, "source_dataset").join(f, "dataset_id", "left")
    return d.groupBy("source_type").agg(F.count(F.lit(1)).alias("datasets"), F.coalesce(F.sum("n"), F.lit(0)).alias("features"), F.round(F.min("positional_accuracy_m"), 3).alias("best_accuracy"))


def c5_geometry(spark, sf_dir):
    """The dataset whose geometry stands for every entity with several, and how many agree with it."""
    c = table(spark, sf_dir, "source_claim").where("property_path = 'geometry' AND entity_id IS NOT NULL AND dataset_id IS NOT NULL AND lower(value_geom.kind) = 'polygon'")
    once = c.groupBy("entity_id", "dataset_id").agg(F.max_by(F.struct("value_geom", "accuracy_m", "id"), F.struct(F.coalesce("observed_on", F.lit("0001-01-01").cast("date")), -F.col("id"))).alias("r"))
    # Metres about the ground's middle are near enough for what lies within a few metres.
    metres = F.transform("r.value_geom.rings", lambda ring: F.transform(ring, lambda p: F.struct(((p["x"] - 81.0) * 109_300.0).alias("x"), ((p["y"] - 11.0) * 110_600.0).alias("y"))))
    own = once.join(table(spark, sf_dir, "source_dataset").select("dataset_id", "source_type", "positional_accuracy_m"), "dataset_id", "left")
    usable = F.when((F.col("r.accuracy_m") > 0) & (F.col("r.accuracy_m") < 100), F.col("r.accuracy_m"))
    rows = own.select("entity_id", "dataset_id", F.struct(F.lit("Polygon").alias("kind"), metres.alias("rings")).alias("geom"), R.prior(F.col("source_type"), F.lit("shape")).alias("mass"), F.coalesce(usable, "positional_accuracy_m").alias("accuracy_m"))
    out = R.fused_geometry(rows)
    return out.select("entity_id", "dataset_id", "members", "claims", F.round("corroboration", 4).alias("corroboration"), F.round("spread", 1).alias("spread"))


def x6_graph(spark, sf_dir):
    """Edges of the provenance graph of all entities by their kind and ends."""
    from terraweave.operators.serving import provenance_graph

    e = durable(_evidence(spark, sf_dir))
    _, edges = provenance_graph(e, table(spark, sf_dir, "source_dataset"), R.decided(e))
    return edges.groupBy("kind", F.substring_index("source", "/", 1).alias("source"), F.substring_index("target", "/", 1).alias("target")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


QUERIES = {
    "c5_geometry": c5_geometry, "x6_graph": x6_graph,
    "c1_claims": c1_claims, "c2_independence": c2_independence, "c6_claims": c6_claims, "c8_strategies": c8_strategies, "c11_queue": c11_queue, "b2_records": b2_records, "b3_confidence": b3_confidence,
    "a4_confidence_summary": a4_confidence_summary, "u4_distinct": u4_distinct, "z6_reliability": z6_reliability, "z15_registry": z15_registry,
}

_PRIORS = "prior_of(source_type, family, prior) AS (VALUES " + ", ".join(f"('{s}', '{f}', {v[k]}::DOUBLE)" for s, v in R.RELIABILITY.items() for k, f in enumerate(R.FAMILIES)) + ")"
_TYPES = "type_of(source_type, nominal, half_life) AS (VALUES " + ", ".join(f"('{s}', {v[7]}::DOUBLE, {v[8]}::DOUBLE)" for s, v in R.RELIABILITY.items()) + ")"
_RANKS = "rank_of(source_type, family, authority) AS (VALUES " + ", ".join(f"('{s}', '{f}', {k})" for f, types in R.PRECEDENCE.items() for k, s in enumerate(types)) + ")"
_KINDS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in R.FAMILY_OF_KIND.items()) + " ELSE 'classification' END"


def _accuracy(a: str, tolerance: float = 1.0) -> str:
    return f"coalesce(1 / (1 + exp(1.9 * log10({a} / {tolerance}) - 0.85)), 0.5)"


_ONCE = problems.KEYED_SQL.replace("WITH names", "WITH RECURSIVE names", 1) + f""", usable AS (
  SELECT k.*, f.kind, c.entity_id, CASE WHEN accuracy_m > 0 AND accuracy_m < 100 THEN accuracy_m END AS acc,
    CASE WHEN isnan(extraction_confidence) THEN NULL WHEN extraction_confidence BETWEEN 0 AND 1 THEN extraction_confidence WHEN extraction_confidence BETWEEN 1 AND 100 THEN extraction_confidence / 100 END AS conf
  FROM keyed AS k JOIN source_claim AS c ON c.id = k.id JOIN canonical_field AS f ON f.field_name = k.field_name WHERE value_key IS NOT NULL AND c.entity_id IS NOT NULL
), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name, dataset_id ORDER BY observed_on DESC NULLS LAST, id) AS rn FROM usable) WHERE rn = 1
), up AS (SELECT dataset_id AS d, unnest(lineage_parents) AS p FROM source_dataset
), walk AS (SELECT dataset_id AS d, dataset_id AS a FROM source_dataset UNION SELECT walk.d, up.p FROM walk JOIN up ON up.d = walk.a
), roots AS (SELECT d, string_agg(a, ',' ORDER BY a) AS roots FROM walk WHERE a NOT IN (SELECT d FROM up) GROUP BY 1
), {_PRIORS}, {_TYPES}, {_RANKS}, weighed AS (
  SELECT o.*, o.value_key AS value, s.source_type, {_KINDS} AS family, authority, roots,
    greatest(0, least(coalesce(prior, 0.5) * (0.45 + 0.55 * coalesce(pow(0.5, greatest(date_diff('day', o.observed_on, DATE '{AS_OF}'), 0) / coalesce(half_life, 730)), 0.75)) * (0.40 + 0.60 * {_accuracy('coalesce(o.acc, s.positional_accuracy_m, nominal, 5)')}) * (1 - least(0.6 * (1 - coalesce(o.conf, 1)), 0.95)), 0.995)) AS plain,
    count(*) OVER (PARTITION BY o.entity_id, o.field_name, coalesce(roots, o.dataset_id)) AS alike
  FROM once AS o LEFT JOIN source_dataset AS s ON s.dataset_id = o.dataset_id LEFT JOIN roots ON roots.d = o.dataset_id LEFT JOIN type_of AS t ON t.source_type = s.source_type
    LEFT JOIN prior_of AS p ON p.source_type = s.source_type AND p.family = {_KINDS} LEFT JOIN rank_of AS r ON r.source_type = s.source_type AND r.family = {_KINDS}
), evidence AS (SELECT *, plain / sqrt(alike) AS mass FROM weighed)"""
_DECIDED = _ONCE + """, h AS (SELECT entity_id, field_name, value, product(1 - least(mass, 0.999)) AS q_h, count(*) AS sources, min(mass) AS m FROM evidence GROUP BY 1, 2, 3
), t AS (SELECT *, product(q_h) OVER g AS theta, count(*) OVER g AS options, sum(sources) OVER g AS claims FROM h WINDOW g AS (PARTITION BY entity_id, field_name)
), u AS (SELECT *, (1 - q_h) * theta / q_h AS raw FROM t), w AS (SELECT *, raw / (sum(raw) OVER g + theta) AS b, (raw + theta) / (sum(raw) OVER g + theta) AS p FROM u WINDOW g AS (PARTITION BY entity_id, field_name)
), best AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY b DESC, value) AS rn FROM w
), high AS (SELECT entity_id, field_name, arg_min(value, struct_pack(a := authority, d := dataset_id)) AS av, arg_min(mass, struct_pack(a := authority, d := dataset_id)) AS am FROM evidence WHERE authority IS NOT NULL GROUP BY 1, 2
), decided AS (SELECT entity_id, field_name, CASE WHEN options > 1 AND av IS NOT NULL THEN av ELSE value END AS value, CASE WHEN claims = 1 THEN 'single_source' WHEN options = 1 THEN 'unanimous' WHEN av IS NOT NULL THEN 'precedence' ELSE 'fusion' END AS strategy,
    CASE WHEN claims = 1 THEN b WHEN options = 1 THEN 1.0 WHEN av IS NOT NULL THEN least(0.99, am + 0.2) ELSE b END AS belief, CASE WHEN options = 1 THEN 1.0 WHEN av IS NOT NULL THEN greatest(least(0.99, am + 0.2), p) ELSE p END AS plausibility,
    options, claims::BIGINT AS claims, options > 1 AND av IS NULL AND (b < 0.40 OR p - b > 0.45) AS escalated FROM best LEFT JOIN high USING (entity_id, field_name) WHERE rn = 1)"""
_SHOWN = "SELECT entity_id, field_name, value, strategy, round(belief, 5) AS belief, round(plausibility, 5) AS plausibility, options, claims, escalated FROM decided"
_WEIGHT = "CASE field_name " + " ".join(f"WHEN '{f}' THEN {w}" for f, w in WEIGHTS.items()) + " ELSE 0 END"
_CONFIDENCE = _DECIDED + f""", own AS (SELECT entity_id, avg(belief) AS b, avg((plausibility - belief < 0.3)::INT) AS sure, sum({_WEIGHT}) AS w FROM decided GROUP BY 1
), said_ AS (SELECT entity_id, count(DISTINCT dataset_id) AS n, min(acc) AS a, coalesce(pow(0.5, greatest(date_diff('day', max(observed_on), DATE '{AS_OF}'), 0) / 1460.0), 0.75) AS r FROM evidence GROUP BY 1
), dims AS (SELECT entity_id, n, CASE WHEN a IS NOT NULL THEN {_accuracy('a', 0.5)} END AS placement, CASE WHEN n <= 1 THEN 0.30 ELSE 0.4 * least(1, (n - 1) / 2) + 0.35 * b + 0.25 * sure END AS agreement, w / {sum(WEIGHTS.values())} AS completeness, 0.3 + 0.7 * r AS currency FROM own JOIN said_ USING (entity_id)
), rated AS (SELECT *, 0.28 * least(1, greatest(0, coalesce(placement, 0.5))) + 0.22 * least(1, greatest(0, agreement)) + 0.18 * 0.5 + 0.14 * least(1, completeness) + 0.10 * least(1, currency) + 0.08 * 0.5 AS confidence FROM dims
), graded AS (SELECT entity_id, n, round(placement, 5) AS placement, round(agreement, 5) AS agreement, round(completeness, 5) AS completeness, round(currency, 5) AS currency, round(confidence, 5) AS confidence,
  CASE WHEN round(confidence, 9) >= 0.9 THEN 'A' WHEN round(confidence, 9) >= 0.75 THEN 'B' WHEN round(confidence, 9) >= 0.6 THEN 'C' WHEN round(confidence, 9) >= 0.4 THEN 'D' ELSE 'E' END AS grade FROM rated)"""

ORACLES = {
    "c1_claims": _ONCE + " SELECT entity_id, field_name, dataset_id, value, family, round(mass, 6) AS mass FROM evidence",
    "c2_independence": _ONCE + " SELECT dataset_id, round(avg(plain), 6) AS alone, round(avg(mass), 6) AS discounted, any_value(roots) AS roots FROM evidence GROUP BY 1",
    "c6_claims": f"{_DECIDED} {_SHOWN}",
    "c8_strategies": f"{_DECIDED}, x AS ({_SHOWN}) SELECT field_name, strategy, count(*) AS n, round(avg(belief), 4) AS mean_belief, count_if(escalated) AS escalated FROM x GROUP BY 1, 2",
    "b2_records": _DECIDED + " SELECT entity_id, " + ", ".join(f"max(value) FILTER (WHERE field_name = '{f}') AS {f}" for f in WEIGHTS) + ", count(*) AS decided, round(min(belief), 5) AS least_belief FROM decided GROUP BY 1",
    "b3_confidence": _CONFIDENCE + " SELECT * FROM graded",
    "a4_confidence_summary": _CONFIDENCE + " SELECT grade, count(*) AS n, round(avg(confidence), 4) AS confidence, round(avg(agreement), 4) AS agreement, round(avg(completeness), 4) AS completeness, round(avg(currency), 4) AS currency FROM graded GROUP BY 1",
    "x6_graph": _DECIDED + """ SELECT 'states' AS kind, 'dataset' AS source, 'field' AS target, count(*) AS n, count(DISTINCT dataset_id) AS sources FROM evidence
UNION ALL SELECT strategy, 'field', 'entity', count(*), count(DISTINCT entity_id || '/' || field_name) FROM decided GROUP BY 1 UNION ALL SELECT 'derives', 'dataset', 'dataset', count(*), count(DISTINCT p) FROM up""",
    "u4_distinct": _ONCE + " SELECT entity_id, field_name, string_agg(DISTINCT value, '|' ORDER BY value) AS \"values\", string_agg(DISTINCT dataset_id, '|' ORDER BY dataset_id) AS sources FROM evidence GROUP BY 1, 2",
    "z6_reliability": f"WITH {_PRIORS}, {_TYPES}, {_RANKS}, f AS (SELECT unnest({list(R.FAMILIES)}) AS family) SELECT dataset_id, f.family, coalesce(prior, 0.5) AS prior, round({_accuracy('coalesce(positional_accuracy_m, nominal, 5)')}, 6) AS accuracy, coalesce(half_life, 730) AS half_life, authority::BIGINT AS authority FROM source_dataset AS s CROSS JOIN f LEFT JOIN prior_of AS p ON p.source_type = s.source_type AND p.family = f.family LEFT JOIN type_of AS t ON t.source_type = s.source_type LEFT JOIN rank_of AS r ON r.source_type = s.source_type AND r.family = f.family",
    "z15_registry": "SELECT source_type, count(*) AS datasets, coalesce(sum(n), 0)::BIGINT AS features, round(min(positional_accuracy_m), 3) AS best_accuracy FROM source_dataset LEFT JOIN (SELECT dataset_id, count(DISTINCT source_feature_id) AS n FROM source_feature GROUP BY 1) USING (dataset_id) GROUP BY 1",
}
