"""Read-side joins, reports and filters over published records: heights, profiles by pattern, catalogues, clips and lookups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.functions import polygons as P
from terraweave.operators.raster import _separable
from terraweave.session import durable_counted, scratch_path

# What the values of a column may look like.
PATTERNS = {
    "integer": r"^-?\d+$", "decimal": r"^-?\d+\.\d+$", "survey_number": r"^\d{1,5}([/\-][0-9A-Za-z]{1,6})*$", "lgd_code": r"^\d{3,7}$", "door_number": r"^[0-9]{1,4}[A-Za-z]?([/\-][0-9A-Za-z]{1,4})*$",
    "gcc_gis_id": r"^[A-Z]-\d{3}-\d{2}-\d{5}$", "date_iso": r"^\d{4}-\d{2}-\d{2}", "date_text": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}", "floors": r"^(G|B)?(\+\d+)?$|^\d{1,3}$", "boolean01": r"^[01]$",
    "name_like": r"^[A-Za-zऀ-෿][A-Za-zऀ-෿ .'\-]{2,}$", "code_alnum": r"^[A-Z0-9_\-]{2,20}$",
}


def value_patterns(values: DataFrame, keys: list[str]) -> DataFrame:
    """Of each column (``keys``), values, mean length and its deviation, and the share of each of PATTERNS, in one scan."""
    hits = [F.avg(F.col("value").rlike(p).cast("int")).alias(name) for name, p in PATTERNS.items()]
    return values.groupBy(*keys).agg(F.count("value").alias("n"), F.avg(F.length("value")).alias("mean_length"), F.stddev_pop(F.length("value")).alias("length_deviation"), *hits)


def resolved_height(stated: Column, floors: Column, storey: float = 3.0, low: float = 2.2, high: float = 300.0) -> Column:
    """STRUCT<height, source>: a plausible stated height, else storeys times their height, else null and ``none``."""
    of_floors = floors * storey
    return (
        F.when(stated.between(low, high), F.struct(stated.alias("height"), F.lit("stated").alias("source")))
        .when((floors > 0) & of_floors.between(low, high), F.struct(of_floors.cast("double").alias("height"), F.lit("floors").alias("source")))
        .otherwise(F.struct(F.lit(None).cast("double").alias("height"), F.lit("none").alias("source")))
    )


def first_failure(tests: dict[str, Column]) -> Column:
    """Name of the first test that holds, in the given order; null where none does."""
    return F.coalesce(*[F.when(t, F.lit(name)) for name, t in tests.items()])


def clipped_counts(features: DataFrame, x1: float, y1: float, x2: float, y2: float) -> tuple[DataFrame, dict[str, int]]:
    """The features whose envelope columns meet a window, stored, and how many were scanned and kept.

    The four comparisons are on plain columns, so they reach the files' row
    group statistics; the number scanned is that of the whole table.
    """
    kept, seen = durable_counted(features.where((F.col("x1") <= x2) & (F.col("x2") >= x1) & (F.col("y1") <= y2) & (F.col("y2") >= y1)), kept=F.count(F.lit(1)))
    return kept, {"scanned": features.count(), "kept": seen["kept"]}


def top_groups(df: DataFrame, keys: list[str], least: int = 5, most: int = 40) -> DataFrame:
    """(key, n) of the groups by the first non-empty of several columns, with ``least`` rows or more: a report of the ``most`` largest."""
    key = F.coalesce(*[F.nullif(F.trim(F.col(k)), F.lit("")) for k in keys])
    return df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(most)


def shared_values(values: DataFrame, record: list[str], source: str) -> DataFrame:
    """Pairs of records of two sources that state one value, whatever the attribute, where each source states it once.

    ``values``: the record's columns, its source and value.  Values that a
    source repeats identify nothing, so no group of rows is paired with another.
    """
    once = values.groupBy(source, "value").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*record)).alias("_r")).where("_n = 1")
    a, b = once.select("value", F.col(source).alias("source_a"), F.col("_r").alias("a")), once.select("value", F.col(source).alias("source_b"), F.col("_r").alias("b"))
    return a.join(b, "value").where("source_a < source_b")


def hull_area(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: the area of the convex hull of all points; hulls of batches come first, so little meets in one task."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 2))
        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)])
            kept = P.convex_hull(np.vstack([kept, rows[np.isfinite(rows).all(1)]])) if len(rows) else kept
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["x", "y"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        hull = P.convex_hull(np.vstack(rows)) if rows else np.zeros((0, 2))
        yield pa.RecordBatch.from_arrays([pa.array([abs(P.ring_area(hull)) if len(hull) > 3 else 0.0])], names=["area"])

    return points.select(F.col(x).alias("x"), F.col(y).alias("y")).mapInArrow(corners, "x double, y double").repartition(1).mapInArrow(whole, "area double")


def filled(cells: DataFrame, half: int = 2, most: int = 64) -> DataFrame:
    """``cells`` (r, c, z) with nulls replaced by the mean of the known cells of a square around, ring by ring up to ``most`` rounds."""
    out, seen = durable_counted(cells, open=F.count_if(F.col("z").isNull()))
    for _ in range(most):
        if not seen["open"]:
            break
        before = seen["open"]
        sums = _separable(out.withColumn("_z", F.coalesce("z", F.lit(0.0))), "_z", half, F.sum).withColumnRenamed("_v", "_sum")
        both = _separable(sums.withColumn("_k", F.col("z").isNotNull().cast("int")), "_k", half, F.sum).withColumnRenamed("_v", "_n")
        out, seen = durable_counted(both.select("r", "c", F.coalesce("z", F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))).alias("z")), open=F.count_if(F.col("z").isNull()))
        if seen["open"] == before:
            break
    return out


def ramp_values(cells: DataFrame, ramp: list[tuple[float, int, int, int]], trust: float = 25.0) -> DataFrame:
    """``cells`` (red, green, blue) with the value of the nearest colour of a ramp, null farther than ``trust`` from all; the smaller value of equals."""
    steps = [F.struct(F.sqrt(F.pow(F.col("red") - r, 2) + F.pow(F.col("green") - g, 2) + F.pow(F.col("blue") - b, 2)).alias("d"), F.lit(float(v)).alias("v")) for v, r, g, b in ramp]
    best = F.array_min(F.array(*steps))
    return cells.withColumn("value", F.when(best["d"] <= trust, best["v"])).withColumn("distance", best["d"])


def phase_offset(reference: np.ndarray, moved: np.ndarray) -> tuple[int, int, float]:
    """(rows, columns, peak): the whole shift of ``moved`` against ``reference`` by phase correlation; a flat image has peak 0."""
    a, b = (np.fft.fft2((m - m.mean()) * np.outer(np.hanning(m.shape[0]), np.hanning(m.shape[1]))) for m in (reference, moved))
    cross = b * np.conj(a)
    size = np.abs(cross)
    if size.max() < 1e-12:
        return 0, 0, 0.0
    surface = np.fft.ifft2(cross / np.maximum(size, 1e-12)).real
    r, c = np.unravel_index(int(np.argmax(surface)), surface.shape)
    n, m = surface.shape
    return int(r - n if r > n // 2 else r), int(c - m if c > m // 2 else c), float(surface.max())


def tile_offsets(cells: DataFrame, tile: int = 64) -> DataFrame:
    """(tile_r, tile_c, rows, columns, peak) of each tile of ``cells`` (r, c, z0, z1), one task a tile; cells that are missing count 0."""
    import pandas as pd

    def offset(rows: pd.DataFrame) -> pd.DataFrame:
        grids = np.zeros((2, tile, tile))
        for k, z in enumerate(("z0", "z1")):
            grids[k, rows["r"].to_numpy() % tile, rows["c"].to_numpy() % tile] = rows[z].fillna(0).to_numpy()
        return pd.DataFrame([(int(rows["r"].iloc[0] // tile), int(rows["c"].iloc[0] // tile), *phase_offset(*grids))], columns=["tile_r", "tile_c", "rows", "columns", "peak"])

    keyed = cells.withColumn("_tr", F.floor(F.col("r") / tile)).withColumn("_tc", F.floor(F.col("c") / tile))
    return keyed.groupBy("_tr", "_tc").applyInPandas(lambda rows: offset(rows), "tile_r bigint, tile_c bigint, rows bigint, columns bigint, peak double")


def publish(spark, parts: dict[str, DataFrame], most: dict[str, tuple[list, int]] | None = None) -> tuple[str, DataFrame]:
    """Write each part as JSON lines into one folder and return it with (part, rows): counts taken while writing.

    ``most`` gives parts that are published as a report: their order and the
    number of rows.
    """
    folder, counts = scratch_path(spark, "published"), []
    for name, df in parts.items():
        if most and name in most:
            order, n = most[name]
            df = df.orderBy(*order).limit(n)
        from pyspark.sql import Observation

        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{folder}/{name}")
        counts.append((name, int(seen.get["n"])))
    return folder, spark.createDataFrame(counts, "part string, rows bigint")
