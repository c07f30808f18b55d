"""Layers derived from the star-schema tables, to run the geospatial operators on.

Coordinates are integers in quarter metres, so that every engine computes the
same values.  The expressions are plain SQL that Spark and other engines read
alike; ``LAYER_SQL`` gives the layers as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraweave.session import table

# name: (table, filter, {column: expression})
LAYERS: dict[str, tuple[str, str, dict[str, str]]] = {
    "parcels_a": (
        "part",
        "p_partkey IS NOT NULL",
        {
            "fid": "p_partkey",
            "x1": "CAST((p_partkey % 100) * 128 AS DOUBLE) / 4",
            "y1": "CAST(floor(p_partkey / 100.0) * 128 AS DOUBLE) / 4",
            "x2": "CAST((p_partkey % 100) * 128 + 64 + (p_size % 12) * 4 AS DOUBLE) / 4",
            "y2": "CAST(floor(p_partkey / 100.0) * 128 + 56 + (p_partkey % 9) * 4 AS DOUBLE) / 4",
            "ward": "p_partkey % 20",
            "zone": "p_partkey % 4",
            "land_use": "p_type",
        },
    ),
    "parcels_b": (
        "part",
        "p_partkey % 11 <> 0",
        {
            "fid": "p_partkey",
            "x1": "CAST((p_partkey % 100) * 128 + 6 AS DOUBLE) / 4",
            "y1": "CAST(floor(p_partkey / 100.0) * 128 + 2 AS DOUBLE) / 4",
            "x2": "CAST((p_partkey % 100) * 128 + 70 + (p_size % 12) * 4 + CASE WHEN p_partkey % 17 = 0 THEN 40 ELSE 0 END AS DOUBLE) / 4",
            "y2": "CAST(floor(p_partkey / 100.0) * 128 + 58 + (p_partkey % 9) * 4 - CASE WHEN p_partkey % 13 = 0 THEN 30 ELSE 0 END AS DOUBLE) / 4",
            "ward": "(p_partkey + CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END) % 20",
            "zone": "p_partkey % 4",
            "land_use": "CASE WHEN p_partkey % 10 < 2 THEN p_brand ELSE p_type END",
        },
    ),
    "buildings": (
        "customer",
        "c_custkey IS NOT NULL",
        {
            "fid": "c_custkey",
            "x1": "CAST((c_custkey % 100) * 128 + (c_custkey * 7) % 60 AS DOUBLE) / 4",
            "y1": "CAST(floor(c_custkey / 100.0) * 128 + (c_custkey * 5) % 50 AS DOUBLE) / 4",
            "x2": "CAST((c_custkey % 100) * 128 + (c_custkey * 7) % 60 + 24 + (c_custkey % 5) * 4 AS DOUBLE) / 4",
            "y2": "CAST(floor(c_custkey / 100.0) * 128 + (c_custkey * 5) % 50 + 20 + (c_custkey % 7) * 4 AS DOUBLE) / 4",
            "height": "CAST(c_custkey % 37 AS DOUBLE) / 2",
            "segment": "c_mktsegment",
        },
    ),
    "claims": (
        "lineitem",
        "l_partkey IS NOT NULL",
        {
            "entity": "l_partkey",
            "dataset": "l_suppkey % 6",
            "ordinal": "l_orderkey * 10 + l_linenumber",
            "value": "CASE WHEN (l_partkey * 7 + l_suppkey % 6 * 3) % 10 < 2 THEN l_returnflag ELSE 'std' END",
            "extent": "l_quantity",
            "observed_on": "CAST(l_shipdate AS DATE)",
        },
    ),
}

REGISTRY = [
    (0, "gnss_cors", 0.99, 0.02, 3650.0),
    (1, "ground_truth", 0.96, 0.20, 1095.0),
    (2, "cadastral_map", 0.55, 3.0, 2555.0),
    (3, "revenue_record", 0.20, 8.0, 1825.0),
    (4, "municipal_gis", 0.74, 1.0, 1460.0),
    (5, "building_footprint", 0.76, 1.2, 1460.0),
]


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, condition, columns = LAYERS[name]
    return table(spark, sf_dir, source).where(condition).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def registry(spark: SparkSession) -> DataFrame:
    """The six sources of the claims: reliability prior, nominal accuracy and half-life in days."""
    return spark.createDataFrame(REGISTRY, "dataset bigint, source_type string, prior double, accuracy_m double, half_life double")


def _cte(name: str) -> str:
    if name == "registry":
        rows = ", ".join(f"({d}, '{s}', {p}::DOUBLE, {a}::DOUBLE, {h}::DOUBLE)" for d, s, p, a, h in REGISTRY)
        return f"registry AS (SELECT * FROM (VALUES {rows}) AS r(dataset, source_type, prior, accuracy_m, half_life))"
    source, condition, columns = LAYERS[name]
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {condition})"


def with_layers(*names: str) -> str:
    """The beginning of a WITH clause that defines some of the layers."""
    return "WITH " + ",\n".join(_cte(n) for n in names)
