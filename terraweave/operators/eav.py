"""Attribute-value rows into wide tables.

Method: the statements are parsed once, reduced to one value per entity and
attribute with partial aggregation (so a hot entity never gathers its rows),
and partitioned by attribute into typed narrow tables.  Each narrow table is
co-partitioned by entity once and joined to the spine of all entities.  The
joins are outer joins from the spine and not a tree of full outer joins: a full
outer join loses its partitioning, so every level of a tree would shuffle
again, whereas all joins from the spine run in one stage over sorted inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.functions import values as V
from terraweave.session import written

SQL_TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}


def field_names(fields: DataFrame) -> DataFrame:
    """One row per spelling of each canonical field: spelling, field_name, kind, dtype, domain, domain_keys."""
    names = F.array_distinct(F.transform(F.concat(F.array("field_name"), F.coalesce("aliases", F.array().cast("array<string>"))), V.bare_key))
    return fields.where("field_name is not null").select(
        F.explode(names).alias("spelling"), "field_name", "kind", "dtype", F.col("value_domain").alias("domain"), F.transform("value_domain", V.bare_key).alias("domain_keys")
    )


def with_parsed_value(df: DataFrame) -> DataFrame:
    """Add ``value``: the canonical text of a statement for its field's kind and type, or null.

    The steps are separate projections: each regular expression runs once a
    row, only for its own type, and the generated code stays small.
    """
    own = df.columns
    df = df.select(*own, V.stated(V.squeezed(F.col("value_text")), F.col("value_num")).alias("_said"))
    kinds = F.when(F.col("dtype").isin("int", "float", "bool"), F.col("dtype")).when(F.col("domain").isNotNull(), "domain").when(F.col("kind") == "identity", "identity").otherwise("code")
    df = df.select(*own, kinds.alias("_kind"), F.lower(V.ascii_digits(F.col("_said"))).alias("_low"))
    is_ = lambda k: F.col("_kind") == k
    first = (
        F.when(is_("int"), V.number_token(F.col("_low")))
        .when(is_("float"), V.amount_token(F.col("_low")))
        .when(is_("domain"), V.bare_key(F.col("_low")))
        .when(is_("identity"), V.dense_identifier(F.col("_low")))
        .otherwise(F.col("_low"))
    )
    df = df.select(*own, "_kind", first.alias("_t"))
    code = F.array_position(F.col("domain_keys"), F.col("_t")).cast("int")
    value = (
        F.when(is_("int"), V.whole_number(F.col("_t")).cast("string"))
        .when(is_("float"), V.area_m2(F.col("_t")).cast("string"))
        .when(is_("bool"), V.truth(F.col("_t")).cast("string"))
        .when(is_("domain"), F.when(code > 0, F.get(F.col("domain"), code - 1)))
        .when(is_("identity"), V.survey_number(F.col("_t")))
        .otherwise(V.code_digits(F.col("_t")))
    )
    return df.select(*own, value.alias("value"))


def resolved_values(claims: DataFrame, fields: DataFrame, entity: list[str]) -> DataFrame:
    """One value per entity and field: the usable statement with the latest observed_on.

    A path names a field when its last dotted part is the field's name or an
    alias, whatever the case and separators.  A null date is the earliest;
    among equal dates the smallest id counts.  Rows with a null entity key,
    unknown paths and unusable values give nothing.
    """
    spelled = claims.select(*entity, "id", "observed_on", "value_text", "value_num", V.bare_key(F.substring_index("property_path", ".", -1)).alias("spelling"))
    keyed = spelled.dropna(subset=entity).join(field_names(fields), "spelling")
    valued = with_parsed_value(keyed).select(*entity, "field_name", "id", "observed_on", "value")
    # A filter on the value would be pushed down and repeat the whole parse; a null rank is skipped instead.
    rank = F.when(F.col("value").isNotNull(), F.struct(F.coalesce("observed_on", F.lit("0001-01-01").cast("date")), -F.col("id")))
    return valued.groupBy(*entity, "field_name").agg(F.max_by("value", rank).alias("value")).where("value is not null")


def joined_to_spine(spine: DataFrame, tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Outer join of all tables to the spine, which has every key once; one exchange a table.

    Sort-merge joins are asked for: sizes of stored tables are those of
    compressed files and bound no broadcast.
    """
    for t in tables:
        spine = spine.join(t.hint("merge"), keys, "left")
    return spine


def eav_to_wide(claims: DataFrame, fields: DataFrame, entity: list[str]) -> DataFrame:
    """One row per entity with a typed column for each canonical field.

    ``claims``: the entity columns, id, property_path, value_text, value_num,
    observed_on.  ``fields``: field_name, kind, dtype, aliases, value_domain.
    Entities without any usable value have no row; an empty claims table gives
    the same columns and no rows.  Further columns are ignored, whatever their
    names.
    """
    spark = claims.sparkSession
    # One entry a column of the result.
    columns = [(r["field_name"], SQL_TYPES.get(r["dtype"], "string")) for r in fields.where("field_name is not null").select("field_name", "dtype").distinct().orderBy("field_name").collect()]
    schema = ", ".join(f"`{e}` {t}" for e, t in claims.select(*entity).dtypes) + ", value string, field_name string"
    path = written(resolved_values(claims, fields, entity), "field_name")
    stored = spark.read.schema(schema).parquet(path)
    narrow = [stored.where(F.col("field_name") == name).select(*entity, F.col("value").cast(kind).alias(name)) for name, kind in columns]
    return joined_to_spine(stored.select(*entity).distinct(), narrow, entity)


def wide_cells(wide: DataFrame, entity: list[str]) -> DataFrame:
    """The filled cells of a wide table as (entity, field_name, value_key).

    A double is given in whole hundredths, other types as plain text.
    """
    shown = [
        F.struct(F.lit(c).alias("field_name"), (F.round(F.col(c) * 100).cast("bigint") if t == "double" else F.col(c)).cast("string").alias("value_key"))
        for c, t in wide.dtypes
        if c not in entity
    ]
    return wide.select(*entity, F.explode(F.array(*shown)).alias("cell")).select(*entity, "cell.field_name", "cell.value_key").where("value_key is not null")
