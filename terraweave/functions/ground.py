"""The survey ground: which positions are usable, and how a feature is placed.

A position is (x, y).  In EPSG:4326 x is the longitude.  All functions return
null for null, NaN and infinite coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.functions.crs import add_lonlat, add_utm

# The extent of the survey ground in degrees and its metric frame.
LON = (80.9, 82.5)
LAT = (10.9, 12.5)
ZONE = 44


def on_ground(lon: Column, lat: Column) -> Column:
    """True where a longitude and latitude lie on the survey ground."""
    return F.coalesce(lon.between(*LON) & lat.between(*LAT), F.lit(False))


def first_position(geom: Column) -> tuple[Column, Column]:
    """Coordinates of a Point geometry; null for other kinds and empty ones."""
    point = F.when(F.lower(geom["kind"]) == "point", F.get(F.get(geom["rings"], F.lit(0)), F.lit(0)))
    return point["x"], point["y"]


def add_place(df: DataFrame, geom_metric: str, geom: str, x: str, y: str) -> DataFrame:
    """Add the metric position of a Point feature; null where neither column places it.

    ``geom_metric`` counts if it is on the ground, else ``geom`` once its axes
    are in order.  A coarse window comes before the inverse projection, so it
    never meets values that are no grid coordinates at all.
    """
    own = df.columns
    mx, my = first_position(F.col(geom_metric))
    gx, gy = first_position(F.col(geom))
    straight, swapped = on_ground(gx, gy), on_ground(gy, gx)
    coarse = mx.between(400000.0, 800000.0) & my.between(1100000.0, 1500000.0)
    df = df.select(
        *own,
        F.when(coarse, mx).alias("_mx"),
        F.when(coarse, my).alias("_my"),
        F.when(straight, gx).when(swapped, gy).alias("_lon"),
        F.when(straight, gy).when(swapped, gx).alias("_lat"),
    )
    df = add_lonlat(df, "_mx", "_my", "_mlon", "_mlat", ZONE)
    df = add_utm(df, "_lon", "_lat", "_gx", "_gy", ZONE)
    metric = on_ground(F.col("_mlon"), F.col("_mlat"))
    return df.select(*own, F.when(metric, F.col("_mx")).otherwise(F.col("_gx")).alias(x), F.when(metric, F.col("_my")).otherwise(F.col("_gy")).alias(y))


def first_rows(df: DataFrame, keys: list[str], order: str, payload: list[str]) -> DataFrame:
    """The row with the smallest ``order`` of each key, narrowed to ``payload``.

    Rows with a null in any key identify nothing and each stand for
    themselves.  Partial minima are taken before the shuffle, so one hot key
    never gathers its rows in one task.
    """
    unkeyed = F.lit(False)
    for k in keys:
        unkeyed = unkeyed | F.col(k).isNull()
    own = F.when(unkeyed, F.col(order)).alias("_own")
    row = F.struct(F.col(order), *[F.col(c) for c in payload if c != order])
    picked = df.select(*keys, own, row.alias("_row")).groupBy(*keys, "_own").agg(F.min_by("_row", F.col("_row")[order]).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in dict.fromkeys([order, *payload]) if c not in keys])
