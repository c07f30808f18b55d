"""Transitive closure of links, for clusters of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.session import discard, durable


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links ``a``-``b``.

    Alternates large-star and small-star: each step ties every node to the
    smallest of its neighbours, so the links turn into one star per component
    in a number of steps logarithmic in its diameter.  Nodes without links are
    their own component; null ends and self-links are ignored.
    """
    stars = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(stars)
    while state[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b")
        after = durable(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        before, state = state, _state(after)
        discard(stars)
        stars = after
        if before == state:
            break
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _state(stars: DataFrame) -> tuple:
    """Count and two order-free hash sums of the links: equal when no link has changed."""
    part = lambda seed: F.sum(F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1 << 31)))
    return tuple(stars.agg(F.count(F.lit(1)), part(1), part(2)).first())
