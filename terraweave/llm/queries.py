"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.functions.ground import LAT, LON
from terraweave.llm.components import consolidated
from terraweave.llm.consensus import best_representatives
from terraweave.llm.matching import matched
from terraweave.llm.packing import packed
from terraweave.llm.textstats import found_forms, quality_statistics, text_totals
from terraweave.llm.tokenizer import token_counts, token_ids
from terraweave.session import durable, table

_END = "\u0000"


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of features that are one parcel or building, with a confidence."""
    return matched(table(spark, sf_dir, "source_feature"), ["parcel", "building"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of features that no claim ties to an entity."""
    feature = ["dataset_id", "source_feature_id"]
    tied = table(spark, sf_dir, "source_claim").where("entity_id is not null").select(*feature).distinct()
    first = table(spark, sf_dir, "source_feature").groupBy(*feature).agg(F.min("id").alias("id"))
    free = durable(first.join(tied, feature, "left_anti").select("id"))
    pairs = p1_matches(spark, sf_dir)
    ends = [free.withColumnRenamed("id", c) for c in ("id_a", "id_b")]
    return pairs.join(ends[0], "id_a", "left_semi").join(ends[1], "id_b", "left_semi").select("id_a", "id_b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim that supplies each field of the surviving record of every entity."""
    claims = table(spark, sf_dir, "source_claim").where("property_path = 'geometry'")
    return best_representatives(claims, "entity_id", LON, LAT)


def p4_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim that supplies each field of every entity when all its claims weigh the same."""
    claims = table(spark, sf_dir, "source_claim").where("property_path = 'geometry'")
    return best_representatives(claims, "entity_id", LON, LAT, precedence=1.0)


def p4_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy and the confidence that most claims of an entity state."""
    return p4_majority(spark, sf_dir).where(F.col("field_name").isin("accuracy_m", "extraction_confidence"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every feature that claims tie to an entity."""
    claims = table(spark, sf_dir, "source_claim").where("entity_id is not null and dataset_id is not null and source_feature_id is not null")
    # The key sorts as dataset_id::source_feature_id; its tail keeps keys apart whose parts hold the separator.
    key = F.concat("dataset_id", F.lit("::"), "source_feature_id", F.lit(_END), F.length("dataset_id").cast("string"))
    found = consolidated(claims.select(key.alias("record"), F.col("entity_id").alias("anchor")))
    plain, width = F.substring_index("record", _END, 1), F.substring_index("record", _END, -1).cast("int")
    return found.select(F.substring(plain, F.lit(1), width).alias("dataset_id"), F.substr(plain, width + 3).alias("source_feature_id"), F.substring_index("group", _END, 1).alias("group_key"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return token_ids(table(spark, sf_dir, "documents"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of each of its parts, for every container size."""
    sizes = token_counts(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("item"), F.col("tokens").alias("size"))
    containers = table(spark, sf_dir, "container_spec").select("spec_id", F.col("capacity_tokens").alias("capacity"))
    found = packed(sizes, containers)
    return found.select("spec_id", F.col("item").alias("doc_id"), "part", F.col("size").alias("tokens"), F.col("container").alias("container_id"))


def _text_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [r["word"] for r in table(spark, sf_dir, "common_word").select("word").distinct().collect()]
    return text_totals(table(spark, sf_dir, "documents"), words)


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality statistics of every document."""
    return quality_statistics(_text_totals(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are lists, tables or junk rather than natural prose."""
    return found_forms(_text_totals(spark, sf_dir))


QUERIES = {"p8_packed": p8_packed, "p1_matches": p1_matches, "p1_found": p1_found, "p9_stats": p9_stats, "p9_found": p9_found, "p4_found": p4_found, "p4_majority": p4_majority, "p4_votes": p4_votes, "p5_found": p5_found, "p7_ids": p7_ids}

_RANKED = """
WITH once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY id) AS rn FROM source_claim WHERE property_path = 'geometry') WHERE rn = 1 AND entity_id IS NOT NULL
), members AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS n FROM once QUALIFY n > 1
), rings AS (SELECT id, unnest(value_geom.rings) AS r FROM members WHERE lower(value_geom.kind) = 'polygon'
), sides AS (
  SELECT id, hash(r) AS h, len(r) - 1 AS k, unnest(range(1, len(r))) AS i, r FROM rings WHERE len(r) >= 4
), seg AS (SELECT id, h, k, i, r[i].x AS ax, r[i].y AS ay, r[i + 1].x AS bx, r[i + 1].y AS by FROM sides
), crossing AS (
  SELECT DISTINCT a.id FROM seg AS a JOIN seg AS b ON a.id = b.id AND a.h = b.h AND a.i + 1 < b.i AND NOT (a.i = 1 AND b.i = b.k)
  WHERE ((a.bx - a.ax) * (b.ay - a.ay) - (a.by - a.ay) * (b.ax - a.ax)) * ((a.bx - a.ax) * (b.by - a.ay) - (a.by - a.ay) * (b.bx - a.ax)) < 0
    AND ((b.bx - b.ax) * (a.ay - b.ay) - (b.by - b.ay) * (a.ax - b.ax)) * ((b.bx - b.ax) * (a.by - b.ay) - (b.by - b.ay) * (a.bx - b.ax)) < 0
), fine AS (
  SELECT id FROM rings GROUP BY id HAVING bool_and(len(r) >= 4 AND r[1] = r[len(r)] AND list_min([p.x FOR p IN r]) >= 80.9 AND list_max([p.x FOR p IN r]) <= 82.5 AND list_min([p.y FOR p IN r]) >= 10.9 AND list_max([p.y FOR p IN r]) <= 12.5
    AND abs(list_sum([(r[i].x - r[1].x) * (r[i + 1].y - r[1].y) - (r[i + 1].x - r[1].x) * (r[i].y - r[1].y) FOR i IN range(1, len(r))])) > 1e-16)
), usable AS (
  SELECT m.id, entity_id, f.id IS NOT NULL AND c.id IS NULL AS geom, CASE WHEN accuracy_m > 0 AND accuracy_m < 100 THEN accuracy_m END AS acc,
    CASE WHEN observed_on >= DATE '1980-01-01' AND observed_on <= created_at::DATE THEN observed_on END AS day,
    CASE WHEN isnan(extraction_confidence) THEN NULL WHEN extraction_confidence BETWEEN 0 AND 1 THEN extraction_confidence WHEN extraction_confidence BETWEEN 1 AND 100 THEN round(extraction_confidence / 100, 9) END AS conf
  FROM members AS m LEFT JOIN fine AS f ON m.id = f.id LEFT JOIN crossing AS c ON m.id = c.id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY acc NULLS LAST, day DESC NULLS LAST, conf DESC NULLS LAST, id) AS rk FROM usable)"""

ORACLES: dict[str, str] = {
    "p4_found": _RANKED + """
SELECT entity_id, 'value_geom' AS field_name, arg_min(id, rk) AS claim_id FROM ranked WHERE geom GROUP BY 1
UNION ALL SELECT entity_id, 'accuracy_m', arg_min(id, rk) FROM ranked WHERE acc IS NOT NULL GROUP BY 1
UNION ALL SELECT entity_id, 'observed_on', arg_min(id, rk) FROM ranked WHERE day IS NOT NULL GROUP BY 1
UNION ALL SELECT entity_id, 'extraction_confidence', arg_min(id, rk) FROM ranked WHERE conf IS NOT NULL GROUP BY 1""",
    "p4_votes": _RANKED + """, v AS (SELECT entity_id, 'accuracy_m' AS field_name, acc AS v, rk, id FROM ranked WHERE acc IS NOT NULL UNION ALL SELECT entity_id, 'extraction_confidence', conf, rk, id FROM ranked WHERE conf IS NOT NULL
), c AS (SELECT entity_id, field_name, v, count(*) AS n, min(rk) AS rk, arg_min(id, rk) AS id FROM v GROUP BY 1, 2, 3)
SELECT entity_id, field_name, arg_min(id, struct_pack(m := -n, rk := rk)) AS claim_id FROM c GROUP BY 1, 2""",
    "p5_found": """
WITH RECURSIVE m AS (
  SELECT DISTINCT dataset_id, source_feature_id, dataset_id || '::' || source_feature_id AS f, entity_id AS e FROM source_claim WHERE entity_id IS NOT NULL AND dataset_id IS NOT NULL AND source_feature_id IS NOT NULL
), links AS (SELECT DISTINCT a.f AS a, b.f AS b FROM m AS a JOIN m AS b USING (e)
), t AS (SELECT f AS node, f AS root FROM m UNION SELECT links.b, t.root FROM t JOIN links ON links.a = t.node)
SELECT DISTINCT m.dataset_id, m.source_feature_id, g.group_key FROM m JOIN (SELECT node, min(root) AS group_key FROM t GROUP BY 1) AS g ON g.node = m.f""",
}
