"""Spatial joins of boxes and points by grid cells.

A box is x1, y1, x2, y2.  Both sides are put into the cells of a grid; the
join is an equi-join on the cell and an inequality on what shares it, so it
shuffles on the cell and never builds a cross product.  A pair that shares
several cells is owned by the cell of the lower left corner of the overlap of
the two (enlarged) boxes, so no distinct follows the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def _cells(df: DataFrame, size: float, scales: tuple[int, ...], grow: float = 0.0) -> DataFrame:
    """``df`` once for every cell it meets, on its own scale and all coarser ones; _own is the first scale whose cells are no less than an eighth of it."""
    width = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + 2 * grow
    own = F.lit(len(scales) - 1)
    for k in range(len(scales) - 2, -1, -1):
        own = F.when(width <= 8 * size * scales[k], k).otherwise(own)
    step = F.get(F.array(*[F.lit(float(size * s)) for s in scales]), F.col("_s"))
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - grow) / step), F.floor((F.col(hi) + grow) / step))
    at = df.withColumn("_own", own).withColumn("_s", F.explode(F.sequence(F.col("_own"), F.lit(len(scales) - 1))))
    return at.withColumn("_u", F.explode(span("x1", "x2"))).withColumn("_v", F.explode(span("y1", "y2")))


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c) if c in ("_s", "_u", "_v") else F.col(c).alias(f"{side}_{c}") for c in df.columns])


def box_join(left: DataFrame, right: DataFrame, radius: float = 0.0, cell: float = 32.0, scales: tuple[int, ...] = (1,)) -> DataFrame:
    """Pairs of boxes whose envelopes lie within ``radius`` of each other (closed intervals).

    Columns of both sides come with the prefixes ``l_`` and ``r_``.  Boxes with
    a null coordinate join nothing; empty sides give no rows; equal boxes are
    all paired.  Where sizes differ widely, ``scales`` gives multiples of the
    cell: a large box goes into few large cells instead of many small ones, and
    a pair meets on the coarser scale of the two.
    """
    a = _sided(_cells(left.dropna(subset=[*BOX]), cell, scales, radius), "l")
    b = _sided(_cells(right.dropna(subset=[*BOX]), cell, scales), "r")
    low_x, low_y = F.greatest(F.col("l_x1") - radius, "r_x1"), F.greatest(F.col("l_y1") - radius, "r_y1")
    meets = (F.col("r_x1") <= F.col("l_x2") + radius) & (F.col("r_x2") >= F.col("l_x1") - radius) & (F.col("r_y1") <= F.col("l_y2") + radius) & (F.col("r_y2") >= F.col("l_y1") - radius)
    step = F.get(F.array(*[F.lit(float(cell * s)) for s in scales]), F.col("_s"))
    owner = (F.col("_s") == F.greatest("l__own", "r__own")) & (F.col("_u") == F.floor(low_x / step)) & (F.col("_v") == F.floor(low_y / step))
    return a.join(b, ["_s", "_u", "_v"]).where(meets & owner).drop("_s", "_u", "_v", "l__own", "r__own")


def area(side: str) -> Column:
    return (F.col(f"{side}_x2") - F.col(f"{side}_x1")) * (F.col(f"{side}_y2") - F.col(f"{side}_y1"))


def overlap() -> Column:
    """Area of the intersection of the two boxes of a pair, in closed form."""
    w = F.least("l_x2", "r_x2") - F.greatest("l_x1", "r_x1")
    h = F.least("l_y2", "r_y2") - F.greatest("l_y1", "r_y1")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def centre_distance() -> Column:
    dx = (F.col("l_x1") + F.col("l_x2") - F.col("r_x1") - F.col("r_x2")) / 2
    dy = (F.col("l_y1") + F.col("l_y2") - F.col("r_y1") - F.col("r_y2")) / 2
    return F.sqrt(dx * dx + dy * dy)


def blocking_join(left: DataFrame, right: DataFrame, radius: float = 3.0, least: float = 0.08, most: float = 12.0, k: int = 8, cell: float = 32.0) -> DataFrame:
    """Candidate pairs: envelopes within the radius, an area ratio in range, the k nearest by centre.

    Among equal distances the smaller right id counts.
    """
    ratio = area("r") / area("l")
    pairs = box_join(left, right, radius, cell).where((area("l") > 0) & ratio.between(least, most)).withColumn("distance", centre_distance())
    nearest = Window.partitionBy("l_fid").orderBy("distance", "r_fid")
    return pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def neighbours(boxes: DataFrame, reach: float = 60.0, cell: float = 64.0) -> DataFrame:
    """Pairs of different boxes whose centres lie within a square of ``reach`` around each other."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    at = boxes.dropna(subset=[*BOX]).select("fid", cx.alias("x1"), cy.alias("y1"), cx.alias("x2"), cy.alias("y2"))
    return box_join(at, at, reach, cell).where("l_fid <> r_fid").select("l_fid", "r_fid", centre_distance().alias("distance"))


def argmax_join(left: DataFrame, right: DataFrame, share: float = 0.25, least: float = 0.0, cell: float = 32.0) -> DataFrame:
    """Each left box with the right box that covers most of it, if at least ``share`` of its area; left outer."""
    pairs = box_join(left, right, 0.0, cell).withColumn("covered", overlap()).where((F.col("covered") > least) & (F.col("covered") >= area("l") * share))
    best = pairs.groupBy(F.col("l_fid").alias("fid")).agg(F.min_by(F.struct("r_fid", "covered"), F.struct(-F.col("covered"), "r_fid")).alias("b"))
    return left.join(best, "fid", "left").select(*left.columns, F.col("b.r_fid").alias("parent"), F.coalesce("b.covered", F.lit(0.0)).alias("covered"))


def nearest_join(points: DataFrame, others: DataFrame, cell: float, k: int = 1, within: float | None = None) -> DataFrame:
    """The k nearest other points within the cell size (or less): exact, by the 3 by 3 cells around each point."""
    reach = cell if within is None else min(within, cell)
    spot = lambda df: df.select("fid", "x", "y", F.floor(F.col("x") / cell).alias("_u"), F.floor(F.col("y") / cell).alias("_v"))
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = spot(points).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).select(F.col("fid").alias("l_fid"), F.col("x").alias("l_x"), F.col("y").alias("l_y"), (F.col("_u") + F.col("_i")).alias("_u"), (F.col("_v") + F.col("_j")).alias("_v"))
    b = spot(others).select(F.col("fid").alias("r_fid"), F.col("x").alias("r_x"), F.col("y").alias("r_y"), "_u", "_v")
    dx, dy = F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y")
    pairs = a.join(b, ["_u", "_v"]).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= reach)
    order = Window.partitionBy("l_fid").orderBy("distance", "r_fid")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("l_fid", "r_fid", "distance", "rank")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], bucket: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time; left outer.

    Both sides are united and carried forward in a window, so the join never
    pairs all rows of a key.  With ``bucket`` (seconds) the windows end with a
    stretch of time and the last row of each stretch is carried to the later
    ones of its key, so a hot key is spread over as many tasks as it has
    stretches; the result is the same.
    """
    stretch = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (bucket * 1_000_000)) if bucket else F.lit(0).cast("bigint")
    a = left.select(*keys, F.col(time).alias("_t"), stretch.alias("_b"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), *[F.lit(None).cast(dict(right.dtypes)[v]).alias(v) for v in values], F.lit(None).cast("boolean").alias("_hit"))
    b = right.select(*keys, F.col(time).alias("_t"), stretch.alias("_b"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *values, F.lit(True).alias("_hit"))
    so_far = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_hit"), F.struct(*values)), ignorenulls=True).over(so_far)
    both = a.unionByName(b)
    out = both.withColumn("_last", last).where("_side = 1")
    if bucket:
        ends = both.groupBy(*keys, "_b").agg(F.max_by(F.struct(*values), F.when(F.col("_hit"), F.col("_t"))).alias("_end"), F.count("_hit").alias("_n"))
        before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.last(F.when(F.col("_n") > 0, F.col("_end")), ignorenulls=True).over(before).alias("_carried"))
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b").eqNullSafe(F.col("_kb"))]
        out = out.join(carried, on, "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return out.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment, as column arithmetic."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square)))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))
