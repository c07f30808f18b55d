"""Claims weighted, fused and resolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.operators import evidence as E
from terraweave.plans.layers import layer, registry, with_layers

AS_OF = "1999-01-01"


def _evidence(spark, sf_dir):
    claims = layer(spark, sf_dir, "claims")
    once = E.one_per_source(claims, ["entity", "dataset"], ["observed_on", "ordinal"], ["value", "extent", "observed_on"])
    joined = once.join(registry(spark), "dataset")
    m = E.mass(F.col("prior"), E.recency(F.col("observed_on"), F.lit(AS_OF).cast("date"), F.col("half_life")), E.accuracy_weight(F.col("accuracy_m")))
    return joined.select("entity", "dataset", "value", "extent", m.alias("mass"))


def c1_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).select("entity", "dataset", "value", F.round("mass", 6).alias("mass"))


def c4_fused(spark, sf_dir):
    out = E.fused(_evidence(spark, sf_dir), ["entity"])
    return out.select("entity", "value", "sources", F.round("belief", 6).alias("belief"), F.round("plausibility", 6).alias("plausibility"))


def c6_resolved(spark, sf_dir):
    out = E.resolved(_evidence(spark, sf_dir), ["entity"])
    return out.select("entity", "value", F.round("belief", 6).alias("belief"), "options", "claims", "strategy", "escalated")


def c3_conflict(spark, sf_dir):
    out = E.conflict_mass(_evidence(spark, sf_dir), ["entity"], ["dataset"])
    return out.select("entity", F.round("conflict", 6).alias("conflict"))


def a16_reliability(spark, sf_dir):
    """Beta posterior of each source: how often its claim is the resolved value."""
    ev = _evidence(spark, sf_dir)
    won = E.resolved(ev, ["entity"]).where("options > 1").select("entity", F.col("value").alias("chosen"))
    wins = ev.join(won, "entity").groupBy("dataset").agg(F.count_if(F.col("value") == F.col("chosen")).alias("wins"), F.count(F.lit(1)).alias("n"))
    return wins.select("dataset", "wins", "n", F.round((F.col("wins") + 10) / (F.col("n") + 20), 6).alias("posterior"))


def c15_summary(spark, sf_dir):
    out = E.resolved(_evidence(spark, sf_dir), ["entity"])
    return out.groupBy("strategy").agg(F.count(F.lit(1)).alias("entities"), F.count_if("escalated").alias("escalated"), F.round(F.avg("belief"), 6).alias("mean_belief"))


QUERIES = {"c1_evidence": c1_evidence, "c3_conflict": c3_conflict, "c4_fused": c4_fused, "c6_resolved": c6_resolved, "a16_reliability": a16_reliability, "c15_summary": c15_summary}

_MASS = with_layers("claims", "registry") + f""",
last AS (SELECT *, row_number() OVER (PARTITION BY entity, dataset ORDER BY observed_on DESC, ordinal DESC) AS rn FROM claims),
ev AS (SELECT entity, l.dataset, value, extent,
  greatest(0, least(0.995, prior * (0.45 + 0.55 * pow(0.5, greatest(date_diff('day', observed_on, DATE '{AS_OF}'), 0) / half_life)) * (0.40 + 0.60 / (1 + exp(1.9 * log10(accuracy_m) - 0.85))))) AS mass
  FROM last AS l JOIN registry AS r ON l.dataset = r.dataset WHERE rn = 1)"""
_FUSED = _MASS + """,
v AS (SELECT entity, value, product(1 - least(mass, 0.999)) AS qh, count(*) AS sources FROM ev GROUP BY 1, 2),
w AS (SELECT *, product(qh) OVER (PARTITION BY entity) AS theta FROM v),
x AS (SELECT *, (1 - qh) * theta / qh AS raw FROM w),
f AS (SELECT *, sum(raw) OVER (PARTITION BY entity) + theta AS total FROM x),
fused AS (SELECT entity, value, sources, raw / total AS belief, (raw + theta) / total AS plausibility FROM f)"""
_RESOLVED = _FUSED + """,
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY belief DESC, value) AS rn, count(*) OVER (PARTITION BY entity) AS options, sum(sources) OVER (PARTITION BY entity) AS claims FROM fused),
s AS (SELECT entity, value, options, claims, CASE WHEN options = 1 AND claims > 1 THEN 1 ELSE belief END AS belief, CASE WHEN options = 1 THEN 1 ELSE plausibility END AS plausibility,
  CASE WHEN claims = 1 THEN 'single_source' WHEN options = 1 THEN 'unanimous' ELSE 'fusion' END AS strategy FROM r WHERE rn = 1),
resolved AS (SELECT *, options > 1 AND (belief < 0.40 OR plausibility - belief > 0.45) AS escalated FROM s)"""

ORACLES = {
    "c1_evidence": _MASS + " SELECT entity, dataset, value, round(mass, 6) AS mass FROM ev",
    "c4_fused": _FUSED + " SELECT entity, value, sources, round(belief, 6) AS belief, round(plausibility, 6) AS plausibility FROM fused",
    "c6_resolved": _RESOLVED + " SELECT entity, value, round(belief, 6) AS belief, options, claims::BIGINT AS claims, strategy, escalated FROM resolved",
    "a16_reliability": _RESOLVED + """ SELECT ev.dataset, count(*) FILTER (WHERE ev.value = resolved.value) AS wins, count(*) AS n,
  round((count(*) FILTER (WHERE ev.value = resolved.value) + 10) / (count(*) + 20), 6) AS posterior FROM ev JOIN resolved USING (entity) WHERE options > 1 GROUP BY 1""",
    "c15_summary": _RESOLVED + " SELECT strategy, count(*) AS entities, count(*) FILTER (WHERE escalated) AS escalated, round(avg(belief), 6) AS mean_belief FROM resolved GROUP BY 1",
    # The conflict of a group, with the masses before each claim written out: what other values hold is the product form of the claims before it.
    "c3_conflict": _MASS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY dataset) AS i FROM ev),
before AS (SELECT a.entity, a.i, a.value, least(a.mass, 0.999) AS m, b.value AS bv, product(1 - least(b.mass, 0.999)) AS q FROM n AS a LEFT JOIN n AS b ON a.entity = b.entity AND b.i < a.i GROUP BY ALL),
tot AS (SELECT *, product(q) OVER (PARTITION BY entity, i) AS qa FROM before),
clash AS (SELECT entity, i, m * coalesce(sum(CASE WHEN bv IS NOT NULL AND bv <> value THEN (1 - q) * qa / q END), 0) AS k FROM tot GROUP BY entity, i, m)
SELECT entity, round(1 - product(1 - k), 6) AS conflict FROM clash GROUP BY 1""",
}
