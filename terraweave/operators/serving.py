"""Read-side operators: filtered pages, search, redaction, validation, extents, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.functions.identifiers import parcel_code
from terraweave.session import durable


def paged(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page in a total order, with the number of all rows that match."""
    total = df.agg(F.count(F.lit(1)).alias("number_matched"))
    page = df.orderBy(*order).offset(offset).limit(limit)
    # One row against a page of at most ``limit`` rows.
    return page.join(F.broadcast(total))


def items(
    records: DataFrame, *, districts: list[str] | None = None, least_confidence: float | None = None, grades: list[str] | None = None, ward: str | None = None, code: str | None = None, number: str | None = None,
    changes: DataFrame | None = None, change: str | None = None, box: tuple[float, float, float, float] | None = None, private: list[str] | None = None, granted: bool = False,
) -> DataFrame:
    """The records that pass every filter that is given, private columns redacted; page the result with ``paged``.

    By district, least confidence, grade, a part of the ward's name, code,
    number, a type of change (of ``changes``: fid and change) and a window over
    the envelope columns.  All but the change are plain comparisons that reach
    the files.
    """
    out = records
    if districts is not None:
        out = out.where(F.col("district").isin(districts))
    if least_confidence is not None:
        out = out.where(F.col("confidence") >= least_confidence)
    if grades is not None:
        out = out.where(F.col("grade").isin(grades))
    if ward is not None:
        out = out.where(F.contains(F.lower(F.col("ward").cast("string")), F.lit(ward.lower())))
    if code is not None:
        out = out.where(F.col("code") == code)
    if number is not None:
        out = out.where(F.col("number") == number)
    if change is not None and changes is not None:
        out = out.join(changes.where(F.col("change") == change).select("fid"), "fid", "left_semi")
    if box is not None:
        x1, y1, x2, y2 = box
        out = out.where((F.col("x1") <= x2) & (F.col("x2") >= x1) & (F.col("y1") <= y2) & (F.col("y2") >= y1))
    return redacted(out, private or [], granted)


def provenance_graph(claims: DataFrame, datasets: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what entities are made of: nodes (node, kind), edges (source, target, kind).

    Datasets state claims, claims concern fields of entities, datasets derive
    from their parents.
    """
    field = F.concat_ws("/", F.lit("field"), "entity_id", "field_name")
    states = claims.select(F.concat_ws("/", F.lit("dataset"), "dataset_id").alias("source"), field.alias("target"), F.lit("states").alias("kind"))
    makes = decisions.select(field.alias("source"), F.concat_ws("/", F.lit("entity"), "entity_id").alias("target"), F.col("strategy").alias("kind"))
    derives = datasets.select(F.explode("lineage_parents").alias("_p"), "dataset_id").select(F.concat_ws("/", F.lit("dataset"), "_p").alias("source"), F.concat_ws("/", F.lit("dataset"), "dataset_id").alias("target"), F.lit("derives").alias("kind"))
    edges = states.unionByName(makes).unionByName(derives)
    ends = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    return ends.select("node", F.substring_index("node", "/", 1).alias("kind")), edges


def redacted(df: DataFrame, private: list[str], granted: bool = False, sign: str = "[redacted]") -> DataFrame:
    """Private columns replaced by a sign where they say something, unless the purpose is granted."""
    return df if granted else df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(sign)) for c in private if c in df.columns})


def problems(required: list[str], domains: dict[str, list[str]], patterns: dict[str, str]) -> Column:
    """Names of what is wrong with a row: missing:<c>, domain:<c>, pattern:<c>, in a fixed order."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    tests = [F.when(empty(c), F.lit(f"missing:{c}")) for c in required]
    tests += [F.when(~empty(c) & ~F.col(c).isin(v), F.lit(f"domain:{c}")) for c, v in domains.items()]
    tests += [F.when(~empty(c) & ~F.col(c).cast("string").rlike(p), F.lit(f"pattern:{c}")) for c, p in patterns.items()]
    return F.array_compact(F.array(*tests))


def searched(sources: list[tuple[DataFrame, list[str]]], needle: str, key: str, limit: int) -> DataFrame:
    """Rows whose joined texts hold the needle, sources in the given order; a top list of ``limit``."""
    out = None
    for rank, (df, columns) in enumerate(sources):
        text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
        hit = df.where(F.contains(text, F.lit(needle.lower()))).select(F.lit(rank).alias("source"), F.col(key).cast("string").alias("key"), text.alias("text"))
        out = hit if out is None else out.unionByName(hit)
    return out.orderBy("source", "key").limit(limit)


def extent(boxes: DataFrame) -> DataFrame:
    return boxes.agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n"))


def overlay(boxes: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """What a proposed box would overlap: area and share of each existing box, largest first by the caller."""
    w = F.least("x2", F.lit(x2)) - F.greatest("x1", F.lit(x1))
    h = F.least("y2", F.lit(y2)) - F.greatest("y1", F.lit(y1))
    met = boxes.where((F.col("x1") <= x2) & (F.col("x2") >= x1) & (F.col("y1") <= y2) & (F.col("y2") >= y1)).withColumn("overlap", F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)))
    return met.where("overlap > 0").select("fid", "overlap", (F.col("overlap") / ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))).alias("share"))


def minted(rows: DataFrame, base: Column, order: str) -> DataFrame:
    """Identifiers that stay unique: the n-th row of one base gets the nonce n, from 0."""
    nth = F.row_number().over(Window.partitionBy("_base").orderBy(order)) - 1
    return rows.withColumn("_base", base).withColumn("nonce", nth).withColumn("minted", F.concat_ws("-", "_base", F.col("nonce").cast("string"))).drop("_base")


def minted_codes(rows: DataFrame, order: str = "fid") -> DataFrame:
    """``rows`` with nonce and code: parcel codes that are unique.

    ``rows``: state, body, key and cell, and ``order``, unique.  The n-th row
    of one key and cell gets the nonce n, from 0.  Where codes of different
    cells are equal all the same (one in a billion pairs), all but the first
    go on to nonces that their cell does not use, until no code is left twice.
    """
    cell = ["state", "body", "key", "cell"]
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy(order)) - 1
    coded = lambda df: durable(df.withColumn("code", parcel_code(*[F.col(c) for c in cell], F.col("nonce"))))
    out = coded(rows.withColumn("nonce", nth))
    while True:
        twice = out.groupBy("code").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("nonce", order)).alias("_first")).where("_n > 1").select("code", F.col("_first")[order].alias("_keeps"))
        twice = durable(twice)
        if twice.isEmpty():
            return out
        used = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_used"))
        marked = out.join(twice, "code", "left").join(used, cell)
        moved = F.col("_keeps").isNotNull() & (F.col("_keeps") != F.col(order))
        out = coded(marked.withColumn("nonce", F.when(moved, F.col("nonce") + F.col("_used")).otherwise(F.col("nonce"))).select(*rows.columns, "nonce"))


def timeline(parts: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """One history of several tables: (entity, at, kind, what), by name of part -> (table, entity, time, text)."""
    out = None
    for kind, (df, entity, at, what) in parts.items():
        rows = df.select(F.col(entity).alias("entity"), F.col(at).cast("timestamp").alias("at"), F.lit(kind).alias("kind"), F.col(what).cast("string").alias("what"))
        out = rows if out is None else out.unionByName(rows)
    return out


def column_profile(df: DataFrame, columns: list[str], patterns: dict[str, str]) -> DataFrame:
    """Nulls, distinct values, lengths, number range and the share of each pattern, one row per column, in one scan."""
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "name", "value")
    number = F.col("value").try_cast("double")
    hits = [F.round(F.avg(F.col("value").rlike(p).cast("int")), 6).alias(n) for n, p in patterns.items()]
    return cells.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_distinct("value").alias("distinct_values"), F.round(F.avg(F.length("value")), 6).alias("mean_length"), F.round(F.stddev_pop(F.length("value")), 6).alias("length_deviation"),
        F.min(number).alias("least"), F.max(number).alias("most"), *hits,
    )
