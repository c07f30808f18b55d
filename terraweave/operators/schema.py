"""Columns of a source mapped onto canonical fields by name and by what their values say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraweave.functions.values import bare_key, squeezed
from terraweave.operators.eav import field_names, with_parsed_value

#: Spellings of canonical fields that become one array expression; more come in several.
MOST_SPELLINGS = 10_000


def crosswalk(values: DataFrame, fields: DataFrame, accept: float = 0.62, review: float = 0.45) -> DataFrame:
    """(dataset_id, attribute, field_name, lexical, instance, score, state), one to one per dataset.

    ``values``: dataset_id, attribute, value.  ``lexical`` is the best edit
    similarity of the column's name with a spelling of the field, ``instance``
    the share of its values that are usable as that field.  Pairs that are
    best for both sides are accepted or kept for review; ties go to the
    smaller name.  Columns without values have no row.
    """
    # A row for each spelling that the canonical schema declares.
    rows = field_names(fields).select("field_name", "spelling").collect()
    columns = values.select("dataset_id", "attribute").distinct()
    named = None
    for k in range(0, max(1, len(rows)), MOST_SPELLINGS):
        some = [F.struct(F.lit(r["field_name"]).alias("field_name"), F.lit(r["spelling"]).alias("spelling")) for r in rows[k : k + MOST_SPELLINGS]]
        spelled = F.array(*some) if some else F.array().cast("array<struct<field_name:string,spelling:string>>")
        part = columns.select("*", F.explode(spelled).alias("s")).select("dataset_id", "attribute", "s.*")
        named = part if named is None else named.unionByName(part)
    key = bare_key(F.col("attribute"))
    close = 1 - F.levenshtein(key, "spelling") / F.greatest(F.length(key), F.length("spelling"), F.lit(1))
    lexical = named.groupBy("dataset_id", "attribute", "field_name").agg(F.max(close).alias("lexical")).where("lexical >= 0.4")
    typed = field_names(fields).groupBy("field_name").agg(*[F.first(c).alias(c) for c in ("kind", "dtype", "domain", "domain_keys")])
    # Values are counted first, so each distinct value is parsed once a column.
    counted = values.where(squeezed(F.col("value")) != "").groupBy("dataset_id", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    asked = counted.join(lexical.join(typed, "field_name"), ["dataset_id", "attribute"]).select("*", F.col("value").alias("value_text"), F.lit(None).cast("double").alias("value_num")).drop("value")
    usable = with_parsed_value(asked).groupBy("dataset_id", "attribute", "field_name", "lexical").agg((F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("instance"))
    blend = 0.55 * F.col("lexical") + 0.45 * F.col("instance")
    scored = usable.withColumn("score", F.when(F.col("lexical") > 0.95, F.greatest(blend, 0.5 + 0.5 * F.col("instance"))).otherwise(blend))
    order = [F.desc("score"), "attribute", "field_name"]
    best = scored.withColumn("_a", F.row_number().over(Window.partitionBy("dataset_id", "attribute").orderBy(*order))).withColumn("_f", F.row_number().over(Window.partitionBy("dataset_id", "field_name").orderBy(*order)))
    state = F.when(F.col("score") >= accept, "accepted").when(F.col("score") >= review, "review")
    return best.where("_a = 1 AND _f = 1").withColumn("state", state).where("state IS NOT NULL").drop("_a", "_f")


def applied(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """Values under their canonical names; unmapped columns are left out."""
    accepted = mapping.where("state = 'accepted'").select("dataset_id", "attribute", "field_name")
    return values.join(accepted, ["dataset_id", "attribute"]).drop("attribute")
