"""Raster operators on cell tables (r, c, z): separable windows, terrain, zones, votes and regions.

A window minimum over a square is the minimum over rows of the minimum over
columns; both are window functions partitioned by a row or a column, so a
raster of any size is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraweave.operators.graph import components


def _separable(cells: DataFrame, value: str, half: int, f) -> DataFrame:
    along = lambda part, order: Window.partitionBy(part).orderBy(order).rangeBetween(-half, half)
    rows = cells.withColumn("_v", f(value).over(along("r", "c")))
    return rows.withColumn("_v", f("_v").over(along("c", "r")))


def eroded(cells: DataFrame, half: int, value: str = "z", out: str = "eroded") -> DataFrame:
    return _separable(cells, value, half, F.min).withColumnRenamed("_v", out)


def dilated(cells: DataFrame, half: int, value: str = "z", out: str = "dilated") -> DataFrame:
    return _separable(cells, value, half, F.max).withColumnRenamed("_v", out)


def ground(cells: DataFrame, windows: tuple[int, ...] = (1, 2, 4, 8), cell: float = 1.0, slope: float = 0.3, least: float = 0.3, most: float = 6.0) -> DataFrame:
    """Progressive morphological filter: the terrain under a surface; never above it."""
    out, before = cells.withColumn("dtm", F.col("z")), 0
    for half in windows:
        limit = min(most, max(least, slope * (half - before) * cell * 2 + least))
        opened = dilated(eroded(out.select("r", "c", "z", "dtm"), half, "dtm", "_e"), half, "_e", "_o")
        out = opened.select("r", "c", "z", F.when(F.col("dtm") - F.col("_o") > limit, F.col("_o")).otherwise(F.col("dtm")).alias("dtm"))
        before = half
    return out.withColumn("ndsm", F.col("z") - F.col("dtm"))


def slope_aspect(cells: DataFrame, cell: float = 1.0) -> DataFrame:
    """Slope in degrees, aspect clockwise from north and hillshade from central differences; null at the edge."""
    rows, cols = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    dx = (F.lead("z").over(rows) - F.lag("z").over(rows)) / (2 * cell)
    dy = (F.lead("z").over(cols) - F.lag("z").over(cols)) / (2 * cell)
    out = cells.withColumn("dx", dx).withColumn("dy", dy)
    s = F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    a = F.atan2("dy", -F.col("dx"))
    zenith, azimuth = 0.7853981633974483, 2.356194490192345
    shade = F.cos(F.lit(zenith)) * F.cos(s) + F.sin(F.lit(zenith)) * F.sin(s) * F.cos(F.lit(azimuth) - a)
    return out.select("r", "c", "z", F.degrees(s).alias("slope"), F.pmod(90 - F.degrees(a), F.lit(360.0)).alias("aspect"), F.greatest(shade, F.lit(0.0)).alias("hillshade"))


def regions(cells: DataFrame, mask: str, width: int = 1 << 20) -> DataFrame:
    """Label of each masked cell: the smallest cell number of its 4-connected region."""
    key = F.col("r").cast("bigint") * width + F.col("c")
    on = cells.where(mask).select("*", key.alias("node"))
    steps = F.array(F.lit(1).cast("bigint"), F.lit(width).cast("bigint"))
    links = on.select(F.col("node").alias("a"), F.explode(steps).alias("d")).select("a", (F.col("a") + F.col("d")).alias("b")).join(on.select(F.col("node").alias("b")), "b")
    return on.join(components(on.select("node"), links), "node").drop("node").withColumnRenamed("component", "region")


def zonal(cells: DataFrame, zones: DataFrame, cell: float = 1.0) -> DataFrame:
    """Height statistics of the cells whose centres lie in each zone box, by an equi-join on grid rows.

    Spark sizes the zones without the rows they are spread over, so it would
    broadcast what the driver can't hold; the join is asked to sort and merge.
    """
    first, last = F.ceil(F.col("y1") / cell - 0.5), F.floor(F.col("y2") / cell - 0.5)
    # A sequence to a smaller number counts down: a zone between two centres has no row.
    z = zones.withColumn("r", F.explode(F.when(first <= last, F.sequence(first, last))))
    inside = z.hint("merge").join(cells, "r").where(((F.col("c") + 0.5) * cell >= F.col("x1")) & ((F.col("c") + 0.5) * cell <= F.col("x2")))
    return inside.groupBy("fid").agg(F.count(F.lit(1)).alias("cells"), F.avg("z").alias("mean"), F.max("z").alias("max"), F.percentile("z", 0.95).alias("p95"), F.stddev_pop("z").alias("deviation"))


def change_votes(before: DataFrame, after: DataFrame, limit: float, half: int = 4, votes: int = 2) -> DataFrame:
    """Cells in which at least ``votes`` of three signs of change agree: value, local contrast, local mean."""
    both = before.select("r", "c", F.col("z").alias("z0")).join(after.select("r", "c", F.col("z").alias("z1")), ["r", "c"]).withColumn("d", F.col("z1") - F.col("z0"))
    spread = both.agg(F.stddev_pop("d").alias("s"), F.avg("d").alias("m"))
    # One row of statistics against the cells.
    both = both.join(F.broadcast(spread))
    mean = _separable(both, "d", half, F.avg)
    total = sum((t.cast("int") for t in (F.abs(F.col("d") - F.col("m")) > 2.5 * F.col("s"), F.abs("d") > limit, F.abs("_v") > limit / 2)), F.lit(0))
    return mean.select("r", "c", "d", total.alias("votes"), (total >= votes).alias("changed"))
