"""Pairwise matches consolidated into groups.

Method: minimum labels are propagated across the links and accelerated with
pointer jumping; every round is cut with a table in the shared checkpoint
folder and the loop ends when no label changes.  Each round hooks every node
onto its smallest neighbour, jumps the pointers to the roots (two levels a
pass) and rewrites the links between roots.  A node that has a smaller
neighbour is gone after the round; what stays are the nodes that are smaller
than all their neighbours, and the links between the groups they head.  A
chain is halved at least; a star whose centre is its largest node needs two
rounds.

Nothing is gathered on the driver but counts, which are observed while a table
is written, and no group is ever held by one task: hot anchors are reduced by
partial minima and joined with salt.  The joins of the rounds are sort-merge
joins: the size of a stored table is that of compressed files, which bounds no
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.session import discard, durable, durable_counted

#: An anchor of more links than this, and than a HOT_SHARE-th of all links, is joined with salt.
HOT_LINKS = 50_000
HOT_SHARE = 10_000


def _merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    return left.hint("merge").join(right.hint("merge"), on, how)


def _stored_links(pairs: DataFrame) -> tuple[DataFrame, int]:
    """The distinct links, larger node first, and whether there are any."""
    links, seen = durable_counted(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), n=F.count(F.lit(1)))
    return links, seen["n"]


def minimum_labels(pairs: DataFrame) -> DataFrame | None:
    """(node, root) of every node that is not the smallest of its group.

    ``pairs``: columns a and b of one orderable type; nulls and self-pairs are
    ignored.  Returns None where no pair links two nodes.
    """
    links, left_over = _stored_links(pairs)
    roots = None
    while left_over:
        parent = _jumped(durable(links.groupBy("a").agg(F.min("b").alias("p"))))
        hooked, stale = parent.select(F.col("a").alias("node"), F.col("p").alias("root")), roots
        if roots is not None:
            hooked = hooked.unionByName(_merge(roots, parent, roots["root"] == parent["a"], "left").select("node", F.coalesce("p", "root").alias("root")))
        roots = durable(hooked)
        left, right = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        before, raised = links, _merge(_merge(links, left, "a"), right, "b", "left").select(F.col("pa").alias("a"), F.coalesce("pb", "b").alias("b"))
        links, left_over = _stored_links(raised)
        discard(before, parent, *([stale] if stale else []))
    return roots


def _jumped(parent: DataFrame) -> DataFrame:
    """Pointer jumping, two levels a pass, until every parent is a root."""
    while True:
        one = parent.select(F.col("a").alias("p"), F.col("p").alias("p1"))
        two = parent.select(F.col("a").alias("p1"), F.col("p").alias("p2"))
        far = _merge(_merge(parent, one, "p", "left"), two, "p1", "left")
        jumped, seen = durable_counted(far.select("a", F.coalesce("p2", "p1", "p").alias("p"), F.col("p2").isNotNull().alias("moved")), moved=F.count_if("moved"))
        discard(parent)
        parent = jumped
        # Where no grandparent had a parent, all pointers end at roots now.
        if not seen["moved"]:
            return parent


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: str, links: str) -> DataFrame:
    """Inner join of ``big`` with one row of ``small`` per key, hot keys split by salt.

    ``links`` of ``small`` is the number of rows of ``big`` that carry the key.
    The list of hot keys has at most HOT_SHARE entries, as each has more than
    that share of all rows; it is the only thing broadcast.
    """
    total = small.agg(F.sum(links)).first()[0] or 0
    limit = max(HOT_LINKS, total // HOT_SHARE)
    hot = small.where(F.col(links) > limit).select(key, (F.col(links) / limit).cast("bigint").alias("_ways"))
    if hot.isEmpty():
        return _merge(big, small.drop(links), key)
    salted = big.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_ways", F.lit(0).cast("bigint")) + 1)).drop("_ways")
    ways = F.when(F.col(links) > limit, (F.col(links) / limit).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), ways))).drop(links)
    return _merge(salted, copies, [key, "_salt"]).drop("_salt")


def consolidated(links: DataFrame) -> DataFrame:
    """(record, group) of every record: records with a common anchor belong together, and so on through others.

    ``links``: record and anchor.  ``group`` is the smallest record of the
    group in the order of its type.  Rows with a null record or anchor link
    nothing; repeated rows count once; a record on its own is its own group;
    an empty table gives no rows.

    Only records of several anchors tie anchors together, so only these enter
    the rounds.
    """
    links = durable(links.select("record", "anchor").dropna().distinct())
    base = durable(links.groupBy("anchor").agg(F.min("record").alias("b"), F.count(F.lit(1)).alias("n")))
    several = links.groupBy("record").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("record")
    ties = salted_join(_merge(links, several, "record", "left_semi"), base, "anchor", "record", "n").select(F.col("record").alias("a"), "b")
    roots = minimum_labels(ties)
    if roots is not None:
        base = _merge(base, roots, base["b"] == roots["node"], "left").select("anchor", F.coalesce("root", "b").alias("b"), "n")
    return salted_join(links, base, "anchor", "record", "n").groupBy("record").agg(F.min("b").alias("group"))
