"""Survey control: transformations by least squares, networks of points and of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.operators.graph import components
from terraweave.operators.grid import box_join, nearest_join, segment_distance
from terraweave.operators.quantiles import exact_quantiles


def helmert(points: DataFrame) -> DataFrame:
    """Scale, rotation (degrees), shift and RMSE of the similarity that fits the weighted points best.

    ``points``: source_x, source_y, target_x, target_y, sigma_m.  The normal
    equations are sums, so the fit is one aggregation and its residuals another.
    """
    w = 1 / F.pow(F.greatest(F.coalesce("sigma_m", F.lit(1.0)), F.lit(1e-6)), 2)
    p = points.select("source_x", "source_y", "target_x", "target_y", w.alias("w"))
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w"))
    centre = p.agg(*[mean(c).alias(f"m_{c}") for c in ("source_x", "source_y", "target_x", "target_y")])
    # One row of sums against the points.
    d = p.join(F.broadcast(centre)).select("*", *[(F.col(c) - F.col(f"m_{c}")).alias(f"d_{c}") for c in ("source_x", "source_y", "target_x", "target_y")])
    s = d.agg(
        F.sum(F.col("w") * (F.col("d_source_x") * F.col("d_target_x") + F.col("d_source_y") * F.col("d_target_y"))).alias("sa"),
        F.sum(F.col("w") * (F.col("d_source_x") * F.col("d_target_y") - F.col("d_source_y") * F.col("d_target_x"))).alias("sb"),
        F.sum(F.col("w") * (F.col("d_source_x") * F.col("d_source_x") + F.col("d_source_y") * F.col("d_source_y"))).alias("ss"),
    ).select(F.try_divide("sa", "ss").alias("a"), F.try_divide("sb", "ss").alias("b"))
    r = d.join(F.broadcast(s)).select(
        "a", "b", (F.col("m_target_x") - F.col("a") * F.col("m_source_x") + F.col("b") * F.col("m_source_y")).alias("tx"), (F.col("m_target_y") - F.col("b") * F.col("m_source_x") - F.col("a") * F.col("m_source_y")).alias("ty"),
        (F.col("d_target_x") - F.col("a") * F.col("d_source_x") + F.col("b") * F.col("d_source_y")).alias("rx"), (F.col("d_target_y") - F.col("b") * F.col("d_source_x") - F.col("a") * F.col("d_source_y")).alias("ry"),
    )
    return r.groupBy("a", "b", "tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))).alias("rmse")).select(
        "n", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("scale"), F.degrees(F.atan2("b", "a")).alias("rotation"), "tx", "ty", "rmse"
    )


def affine(points: DataFrame) -> DataFrame:
    """The six coefficients of the affine fit by Cramer's rule on centred sums, and its RMSE."""
    mean = points.agg(*[F.avg(c).alias(f"m_{c}") for c in ("source_x", "source_y", "target_x", "target_y")])
    d = points.join(F.broadcast(mean)).select("*", (F.col("source_x") - F.col("m_source_x")).alias("u"), (F.col("source_y") - F.col("m_source_y")).alias("v"), (F.col("target_x") - F.col("m_target_x")).alias("p"), (F.col("target_y") - F.col("m_target_y")).alias("q"))
    s = d.agg(*[F.sum(F.col(x) * F.col(y)).alias(x + y) for x, y in ("uu", "uv", "vv", "up", "vp", "uq", "vq")])
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    solve = lambda x, y: (F.try_divide(F.col(x) * F.col("vv") - F.col(y) * F.col("uv"), det), F.try_divide(F.col(y) * F.col("uu") - F.col(x) * F.col("uv"), det))
    (a, b), (c, e) = solve("up", "vp"), solve("uq", "vq")
    k = s.select(a.alias("a"), b.alias("b"), c.alias("c"), e.alias("d"))
    r = d.join(F.broadcast(k)).select("a", "b", "c", "d", (F.col("p") - F.col("a") * F.col("u") - F.col("b") * F.col("v")).alias("rx"), (F.col("q") - F.col("c") * F.col("u") - F.col("d") * F.col("v")).alias("ry"), (F.col("m_target_x") - F.col("a") * F.col("m_source_x") - F.col("b") * F.col("m_source_y")).alias("tx"), (F.col("m_target_y") - F.col("c") * F.col("m_source_x") - F.col("d") * F.col("m_source_y")).alias("ty"))
    return r.groupBy("a", "b", "c", "d", "tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))).alias("rmse"))


def blunders(points: DataFrame, limit: float = 3.0) -> DataFrame:
    """Points whose shift lies more than ``limit`` scaled deviations from the median shift."""
    d = points.select("gcp_id", (F.col("target_x") - F.col("source_x")).alias("dx"), (F.col("target_y") - F.col("source_y")).alias("dy"))
    mid = exact_quantiles(d, mx=("dx", 0.5), my=("dy", 0.5))
    r = d.join(F.broadcast(mid)).withColumn("r", F.sqrt(F.pow(F.col("dx") - F.col("mx"), 2) + F.pow(F.col("dy") - F.col("my"), 2)))
    scale = exact_quantiles(r, m=("r", 0.5)).select((F.col("m") * 1.4826).alias("s"))
    return r.join(F.broadcast(scale)).where((F.col("s") > 0) & (F.col("r") > limit * F.col("s"))).select("gcp_id", "r")


def network_report(points: DataFrame, reach: float, usable: float = 0.10) -> DataFrame:
    """Points, usable ones, mean sigma and the widest gap to a nearest neighbour within ``reach``."""
    at = points.select(F.col("gcp_id").alias("fid"), F.col("target_x").alias("x"), F.col("target_y").alias("y"))
    near = nearest_join(at, at, reach, 2).where("l_fid <> r_fid").groupBy("l_fid").agg(F.min("distance").alias("d"))
    gap = near.agg(F.max("d").alias("widest_gap"), F.count(F.lit(1)).alias("with_neighbour"))
    own = points.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sigma_m") <= usable).alias("usable"), F.avg("sigma_m").alias("mean_sigma"))
    return own.join(F.broadcast(gap)).select("n", "usable", "mean_sigma", "with_neighbour", "widest_gap")


def _node(x: Column, y: Column) -> Column:
    return F.concat_ws(" ", F.format_string("%.3f", x), F.format_string("%.3f", y))


def network_nodes(edges: DataFrame) -> DataFrame:
    """Degree, component and dangle of every node of a line network; nodes are ends rounded to millimetres."""
    ends = edges.select("eid", _node(F.col("x1"), F.col("y1")).alias("a"), _node(F.col("x2"), F.col("y2")).alias("b"))
    both = ends.select(F.col("a").alias("node"), "eid").unionByName(ends.select(F.col("b").alias("node"), "eid"))
    degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    parts = components(degree.select("node"), ends.select("a", "b"))
    return degree.join(parts, "node").select("node", "degree", "component", (F.col("degree") == 1).alias("dangle"))


def undershoots(edges: DataFrame, reach: float = 1.0, cell: float = 50.0) -> DataFrame:
    """Dangling ends that stop short of another line within ``reach``: the closest line of each."""
    ends = edges.select("eid", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("eid", "p.x", "p.y")
    dangles = ends.join(network_nodes(edges).where("dangle").select("node"), _node(F.col("x"), F.col("y")) == F.col("node"), "left_semi")
    left = dangles.select(F.col("eid").alias("fid"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    lines = edges.select(F.col("eid").alias("fid"), F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"), F.struct("x1", "y1", "x2", "y2").alias("line"))
    pairs = box_join(left, lines, reach, cell).where("l_fid <> r_fid")
    d = segment_distance(F.col("l_x1"), F.col("l_y1"), F.col("r_line.x1"), F.col("r_line.y1"), F.col("r_line.x2"), F.col("r_line.y2"))
    near = pairs.withColumn("distance", d).where((F.col("distance") > 0) & (F.col("distance") <= reach))
    first = Window.partitionBy("l_fid", "l_x1", "l_y1").orderBy("distance", "r_fid")
    return near.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("l_fid").alias("eid"), F.col("r_fid").alias("other"), "distance")
