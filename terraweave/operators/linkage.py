"""Explainable links between two layers of boxes: features, votes, score, assignment, events, change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.operators.grid import area, blocking_join, centre_distance, overlap
from terraweave.operators.quantiles import exact_quantiles
from terraweave.session import durable


def pair_features(pairs: DataFrame) -> DataFrame:
    """Overlap, containment, normalised distance, log area ratio and attribute agreement of each pair."""
    inter = overlap()
    union = area("l") + area("r") - inter
    radius = F.sqrt(F.least(area("l"), area("r")) / 3.141592653589793)
    same = lambda c: F.when(F.col(f"l_{c}").isNull() | F.col(f"r_{c}").isNull(), 0.5).when(F.col(f"l_{c}") == F.col(f"r_{c}"), 1.0).otherwise(0.0)
    return pairs.select(
        "l_fid", "r_fid", (inter / union).alias("iou"), (inter / F.least(area("l"), area("r"))).alias("containment"), (centre_distance() / radius).alias("dist_norm"), F.abs(F.log(area("r") / area("l"))).alias("log_area"),
        same("ward").alias("attr_ward"), same("land_use").alias("attr_use"), area("l").alias("l_area"), area("r").alias("r_area"),
        ((F.col("r_x1") + F.col("r_x2") - F.col("l_x1") - F.col("l_x2")) / 2).alias("dx"), ((F.col("r_y1") + F.col("r_y2") - F.col("l_y1") - F.col("l_y2")) / 2).alias("dy"),
    )


def with_ranks(features: DataFrame) -> DataFrame:
    """Rank of a pair among its endpoints' candidates by overlap, their best overlaps and mutual best."""
    left, right = Window.partitionBy("l_fid"), Window.partitionBy("r_fid")
    order = [F.desc("iou"), "l_fid", "r_fid"]
    out = features.select(
        "*", (F.row_number().over(left.orderBy(*order)) - 1).alias("rank_left"), (F.row_number().over(right.orderBy(*order)) - 1).alias("rank_right"), F.max("iou").over(left).alias("best_left"), F.max("iou").over(right).alias("best_right")
    )
    return out.withColumn("mutual", (F.col("rank_left") == 0) & (F.col("rank_right") == 0) & (F.col("iou") > 0))


def plausible() -> Column:
    """Pairs that touch, contain or lie near each other go on to the costly features."""
    return (F.col("iou") > 0) | (F.col("containment") > 0.02) | (F.col("dist_norm") <= 2.5)


def votes() -> list[Column]:
    """The labelling functions: 1 match, 0 no match, null no opinion."""
    best = F.greatest("best_left", "best_right")
    return [
        F.when((F.col("iou") >= 0.62) & F.col("mutual"), 1),
        F.when((F.col("containment") >= 0.85) & F.col("mutual") & (F.exp(-F.col("log_area")) >= 0.35) & (F.col("dist_norm") <= 0.9), 1),
        F.when((F.col("iou") <= 1e-9) & (F.col("dist_norm") > 5), 0),
        F.when((F.col("log_area") > 2.3) & (F.col("containment") < 0.55), 0),
        F.when((F.col("iou") < 0.15) & (F.col("best_left") > 0.65) & (F.col("best_right") > 0.65), 0),
        F.when(~F.col("mutual") & (best >= 0.55) & F.col("iou").between(0.05, 0.65) & (F.col("iou") <= 0.55 * best), 0),
    ]


def weak_label(opinions: list[Column]) -> Column:
    """The unanimous opinion of all that have one, else -1."""
    given = F.array_distinct(F.array_compact(F.array(*opinions)))
    return F.when(F.size(given) == 1, F.get(given, F.lit(0))).otherwise(-1)


def geometric_score() -> Column:
    """A fixed weighted score between 0 and 1, the default where no model is trained."""
    similar_area = F.exp(-F.col("log_area"))
    attributes = (F.col("attr_ward") + F.col("attr_use")) / 2
    return 0.34 * F.col("iou") + 0.16 * F.col("containment") + 0.18 * F.exp(-F.col("dist_norm") / 1.5) + 0.12 + 0.10 * similar_area + 0.10 * attributes


def scored_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    pairs = with_ranks(pair_features(blocking_join(left, right)).where(plausible()))
    return pairs.withColumn("label", weak_label(votes())).withColumn("score", geometric_score())


def mutual_assignment(scored: DataFrame, accept: float = 0.55, flag: float = 0.35) -> DataFrame:
    """One-to-one links: pairs that are the best of both ends by score; accepted or flagged by level."""
    order = [F.desc("score"), "l_fid", "r_fid"]
    best = scored.withColumn("_a", F.row_number().over(Window.partitionBy("l_fid").orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy("r_fid").orderBy(*order)))
    state = F.when(F.col("score") >= accept, "accepted").when(F.col("score") >= flag, "flagged")
    return best.where("_a = 1 AND _b = 1").withColumn("state", state).where("state IS NOT NULL").drop("_a", "_b")


def registration_offset(scored: DataFrame, overlap_least: float = 0.55) -> DataFrame:
    """Median displacement of the right layer, residual scatter and whether it is significant."""
    good = durable(scored.where(F.col("iou") >= overlap_least).select("dx", "dy"))
    middle = exact_quantiles(good, mx=("dx", 0.5), my=("dy", 0.5)).join(F.broadcast(good.agg(F.count(F.lit(1)).alias("n"))))
    # One row against the links: its size is one by construction.
    spread = good.join(F.broadcast(middle)).groupBy("mx", "my", "n").agg(F.sqrt(F.avg(F.pow(F.col("dx") - F.col("mx"), 2) + F.pow(F.col("dy") - F.col("my"), 2))).alias("rms"))
    size = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))
    return spread.select("n", F.col("mx").alias("dx"), F.col("my").alias("dy"), size.alias("offset"), F.pmod(F.degrees(F.atan2("mx", "my")), F.lit(360.0)).alias("bearing"), "rms", ((F.col("n") >= 25) & (size >= 0.3)).alias("significant"))


def changes(left: DataFrame, right: DataFrame, links: DataFrame, offset: tuple[float, float] = (0.0, 0.0), shift: float = 0.75, growth: float = 0.08, extension: float = 6.0, loss: float = 0.75) -> DataFrame:
    """Typed differences between two epochs: new and removed by anti-join, the rest by size and place."""
    delta = F.col("r_area") - F.col("l_area")
    moved = F.sqrt(F.pow(F.col("dx") - offset[0], 2) + F.pow(F.col("dy") - offset[1], 2))
    kind = (
        F.when(F.col("r_area") <= F.col("l_area") * (1 - loss), "demolition")
        .when((delta / F.col("l_area") >= growth) & (delta >= extension), "extension")
        .when((delta / F.col("l_area") <= -growth) & (delta <= -extension), "reduction")
        .when((F.abs(delta / F.col("l_area")) < growth) & (moved > shift), "displacement")
        .otherwise("no_change")
    )
    kept = links.select(F.col("l_fid").alias("fid"), kind.alias("change"), delta.alias("area_delta"))
    gone = left.join(links.select(F.col("l_fid").alias("fid")), "fid", "left_anti").select("fid", F.lit("removed").alias("change"), (-(F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area_delta"))
    new = right.join(links.select(F.col("r_fid").alias("fid")), "fid", "left_anti").select("fid", F.lit("new").alias("change"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area_delta"))
    return kept.unionByName(gone).unionByName(new)


def cardinality_groups(live: DataFrame, components: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Type of each component of live pairs: 1:1, 1:N, N:1 or N:M, and whether its area is conserved.

    ``live``: l_fid, r_fid, l_area, r_area; ``components``: node (``l:`` or
    ``r:`` with the fid) and component.
    """
    ends = live.select(F.concat(F.lit("l:"), F.col("l_fid").cast("string")).alias("node"), F.col("l_area").alias("a")).unionByName(live.select(F.concat(F.lit("r:"), F.col("r_fid").cast("string")).alias("node"), F.col("r_area").alias("a"))).distinct()
    sides = ends.join(components, "node").withColumn("left", F.startswith("node", F.lit("l:")))
    c = sides.groupBy("component").agg(F.count_if("left").alias("n_left"), F.count_if(~F.col("left")).alias("n_right"), F.sum(F.when(F.col("left"), F.col("a"))).alias("left_area"), F.sum(F.when(~F.col("left"), F.col("a"))).alias("right_area"))
    one_l, one_r = F.col("n_left") == 1, F.col("n_right") == 1
    kind = F.when(one_l & one_r, "1:1").when(one_l, "1:N").when(one_r, "N:1").otherwise("N:M")
    conserved = F.abs(F.col("left_area") - F.col("right_area")) / F.greatest("left_area", "right_area") <= tolerance
    return c.select("component", "n_left", "n_right", kind.alias("cardinality"), conserved.alias("conserved"))
