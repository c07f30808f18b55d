"""Links between layers of polygons: attribute agreement, optimal one-to-one assignment, events, clusters, change and a learned score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.functions import identifiers as I
from terraweave.operators.graph import components
from terraweave.session import durable

#: Components with more cells than this square are linked greedily.
MOST_SIDE = 400


# --- attributes --------------------------------------------------------------


def survey_agreement(a: Column, b: Column) -> Column:
    """1 for equal numbers, 0.35 for parts of one parent number, 0 for others, 0.5 where one is unknown."""
    same = I.parent_number(a) == I.parent_number(b)
    return F.when(a.isNull() | b.isNull(), 0.5).when(a == b, 1.0).when(same, 0.35).otherwise(0.0)


def admin_agreement(pairs: list[tuple[Column, Column]]) -> Column:
    """Share of the attributes stated on both sides that agree without leading zeros and case; 0.5 where none is."""
    plain = lambda c: F.nullif(F.ltrim(F.lower(F.trim(c)), F.lit("0")), F.lit(""))
    both = [(plain(a).isNotNull() & plain(b).isNotNull(), plain(a) == plain(b)) for a, b in pairs]
    told = sum((t.cast("int") for t, _ in both), F.lit(0))
    hits = sum((F.when(t & h, 1).otherwise(0) for t, h in both), F.lit(0))
    return F.when(told > 0, hits / told).otherwise(0.5)


def neighbour_agreement(pairs: DataFrame, reach: float = 60.0) -> DataFrame:
    """``pairs`` (l_fid, r_fid, lx, ly, dx, dy) with agreement: how alike the displacements of the pairs around are.

    A neighbour counts by the displacement of its nearest candidate; the mean
    of exp(-difference / 2) over all neighbours in a square, 0.5 without any.
    """
    from terraweave.operators.grid import box_join

    best = pairs.groupBy("l_fid").agg(F.min_by(F.struct("lx", "ly", "dx", "dy"), F.struct(F.hypot("dx", "dy"), "r_fid")).alias("b")).select("l_fid", "b.*")
    at = best.select("l_fid", "dx", "dy", F.col("lx").alias("x1"), F.col("ly").alias("y1"), F.col("lx").alias("x2"), F.col("ly").alias("y2"))
    near = box_join(at, at, reach, reach * 2).where("l_l_fid <> r_l_fid").select(F.col("l_l_fid").alias("l_fid"), F.col("r_dx").alias("_dx"), F.col("r_dy").alias("_dy"))
    told = pairs.select("l_fid", "r_fid", "dx", "dy").join(near, "l_fid").groupBy("l_fid", "r_fid").agg(F.avg(F.exp(-F.hypot(F.col("_dx") - F.col("dx"), F.col("_dy") - F.col("dy")) / 2)).alias("_a"))
    return pairs.join(told, ["l_fid", "r_fid"], "left").withColumn("agreement", F.coalesce("_a", F.lit(0.5))).drop("_a")


# --- assignment --------------------------------------------------------------


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of the assignment of least total cost (shortest augmenting paths with potentials)."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[at]:
            used[at] = True
            row = owner[at]
            reduced = np.append(np.inf, c[row - 1] - u[row] - v[1:])
            better = ~used & (reduced < least)
            least[better], way[better] = reduced[better], at
            step = np.where(used, np.inf, least)
            following = int(np.argmin(step))
            delta = step[following]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            at = following
        while at:
            before = way[at]
            owner[at] = owner[before]
            at = before
    found = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(j, i) for i, j in found] if turned else found


def greedy_links(pairs: DataFrame) -> DataFrame:
    """One-to-one links by falling p: the pairs that are best for both ends stand and take their ends out, round by round."""
    left, done = durable(pairs), None
    while not left.isEmpty():
        rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("p"), "l_fid", "r_fid"))
        best = durable(left.withColumn("_a", rank("l_fid")).withColumn("_b", rank("r_fid")).where("_a = 1 AND _b = 1").drop("_a", "_b"))
        done = best if done is None else done.unionByName(best)
        left = durable(left.join(best.select("l_fid"), "l_fid", "left_anti").join(best.select("r_fid"), "r_fid", "left_anti"))
    return pairs.limit(0) if done is None else done


def optimal_links(pairs: DataFrame, live: float = 0.35, accept: float = 0.55) -> DataFrame:
    """``pairs`` (l_fid, r_fid, p) that are linked one to one with the greatest total p, and their state.

    Pairs of at least ``live`` form components; each is solved on its own, the
    cost of a pair being 1 - p and of a missing one 1.  Components with more
    than MOST_SIDE squared cells are linked greedily, spread over the cluster.
    """
    name = lambda side: F.concat(F.lit(f"{side}:"), F.col(f"{side}_fid").cast("string"))
    alive = durable(pairs.where(F.col("p") >= live))
    links = alive.select(name("l").alias("a"), name("r").alias("b"))
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    placed = durable(alive.withColumn("node", name("l")).join(components(nodes, links), "node").drop("node"))
    sizes = placed.groupBy("component").agg((F.countDistinct("l_fid") * F.countDistinct("r_fid")).alias("cells"))
    sized = placed.join(sizes, "component")
    columns = pairs.columns
    schema = pairs.schema

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["l_fid", "r_fid"]).reset_index(drop=True)
        l, r = (pd.Index(sorted(rows[c].unique())) for c in ("l_fid", "r_fid"))
        cost, which = np.ones((len(l), len(r))), np.full((len(l), len(r)), -1)
        i, j = l.get_indexer(rows["l_fid"]), r.get_indexer(rows["r_fid"])
        cost[i, j], which[i, j] = 1 - rows["p"].to_numpy(float), np.arange(len(rows))
        keep = [which[a, b] for a, b in hungarian(cost) if which[a, b] >= 0]
        return rows.iloc[sorted(keep)][columns]

    small = sized.where(F.col("cells") <= MOST_SIDE**2).groupBy("component").applyInPandas(solve, schema)
    large = sized.where(F.col("cells") > MOST_SIDE**2).select(*columns)
    out = small if large.isEmpty() else small.unionByName(greedy_links(large))
    return out.withColumn("state", F.when(F.col("p") >= accept, "accepted").otherwise("flagged"))


# --- what follows from links -------------------------------------------------


def parcel_events(groups: DataFrame, left: DataFrame, right: DataFrame, live: DataFrame) -> DataFrame:
    """(event, n, conserved): what became of the left layer's parcels, by the groups of live pairs and what is in none."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in (("1:1", "kept"), ("1:N", "subdivision"), ("N:1", "amalgamation"), ("N:M", "reorganisation")) for x in kv]), F.col("cardinality"))
    grouped = groups.groupBy(kind.alias("event")).agg(F.count(F.lit(1)).alias("n"), F.count_if("conserved").alias("conserved"))
    alone = lambda layer, side, event: layer.join(live.select(F.col(f"{side}_fid").alias("fid")), "fid", "left_anti").agg(F.lit(event).alias("event"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("conserved"))
    return grouped.unionByName(alone(left, "l", "retired")).unionByName(alone(right, "r", "new"))


def clusters(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, members, datasets, support, kind): features of all layers joined by accepted edges, those alone included.

    ``features``: fid and dataset_id; ``edges``: a and b.  Support is the share
    of possible edges that were found; a cluster with two features of one
    dataset is N:M.  No feature is lost and all members count.
    """
    c = components(features.select(F.col("fid").alias("node")), edges)
    placed = features.join(c, features["fid"] == c["node"])
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("dataset_id").alias("datasets"), F.array_join(F.array_sort(F.collect_set("dataset_id")), ",").alias("sources"))
    found = edges.join(c, edges["a"] == c["node"]).groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    k = F.col("members")
    support = F.when(k > 1, F.least(F.lit(1.0), F.coalesce("edges", F.lit(0)) / (k * (k - 1) / 2))).otherwise(0.0)
    kind = F.when(k == 1, "single").when(k > F.col("datasets"), "N:M").otherwise("1:1")
    return sizes.join(found, "component", "left").select(F.col("component").alias("cluster"), "members", "datasets", "sources", support.alias("support"), kind.alias("kind"))


def typed_differences(links: DataFrame, left: DataFrame, right: DataFrame, cross_source: bool, shift: float = 0.75, growth: float = 0.08, extension: float = 6.0, loss: float = 0.75) -> DataFrame:
    """(fid, difference, area_delta, actionable) of two layers.

    ``links``: l_fid, r_fid, l_area, r_area, moved (metres, less the layers'
    common offset) and attributes (how many watched ones differ); ``left`` and
    ``right``: fid and area.  Between epochs the differences are change;
    between sources they are disagreement, and what one lacks is an omission
    or a commission, never a demolition.  Displacement and disagreement of
    attributes alone change no outline and are not actionable.
    """
    delta = F.col("r_area") - F.col("l_area")
    ratio = delta / F.col("l_area")
    size = F.when(F.col("r_area") <= F.col("l_area") * (1 - loss), "demolition").when((ratio >= growth) & (delta >= extension), "extension").when((ratio <= -growth) & (delta <= -extension), "reduction")
    place = F.when((F.abs(ratio) < growth) & (F.col("moved") > shift), "displacement")
    kind = F.coalesce(size, place, F.when(F.col("attributes") > 0, "attribute_change"), F.lit("no_change"))
    renamed = {"demolition": "geometric_disagreement", "extension": "geometric_disagreement", "reduction": "geometric_disagreement", "displacement": "positional_disagreement", "attribute_change": "attribute_disagreement", "no_change": "agreement"}
    named = F.element_at(F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv]), kind) if cross_source else kind
    gone, new = ("source_omission", "source_commission") if cross_source else ("removed", "new")
    kept = links.select(F.col("l_fid").alias("fid"), named.alias("difference"), delta.alias("area_delta"))
    a = left.join(links.select(F.col("l_fid").alias("fid")), "fid", "left_anti").select("fid", F.lit(gone).alias("difference"), (-F.col("area")).alias("area_delta"))
    b = right.join(links.select(F.col("r_fid").alias("fid")), "fid", "left_anti").select("fid", F.lit(new).alias("difference"), F.col("area").alias("area_delta"))
    quiet = ["no_change", "agreement", "displacement", "positional_disagreement", "attribute_change", "attribute_disagreement"]
    return kept.unionByName(a).unionByName(b).withColumn("actionable", ~F.col("difference").isin(quiet))


def attribute_deltas(before: Column, after: Column, watched: list[str]) -> Column:
    """MAP of the watched keys that differ beyond case and blanks, nulls skipped, to STRUCT<before, after>."""
    plain = lambda c: F.nullif(F.regexp_replace(F.lower(c), r"\s+", ""), F.lit(""))
    rows = [F.when(plain(before[k]).isNotNull() & plain(after[k]).isNotNull() & (plain(before[k]) != plain(after[k])), F.struct(F.lit(k).alias("key"), F.struct(before[k].alias("before"), after[k].alias("after")).alias("value"))) for k in watched]
    return F.map_from_entries(F.array_compact(F.array(*rows)))


# --- a learned score ---------------------------------------------------------


def fit_matcher(pairs: DataFrame, features: list[str], label: str = "label", most: int = 20_000, least: int = 40, seed: int = 7) -> PipelineModel | None:
    """Gradient-boosted trees over pairs with a weak label of 0 or 1, both classes weighing the same; None with too few labels.

    At most about ``most`` labelled rows are used, drawn by a hash of the pair,
    so the sample is the same wherever the rows lie.  The model is saved and
    loaded as any pipeline model.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    told = durable(pairs.where(F.col(label).isin(0, 1)).select("l_fid", "r_fid", F.col(label).cast("double").alias("label"), *features))
    counts = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    if len(counts) < 2 or n < least:
        return None
    share = min(1.0, most / n)
    weight = F.when(F.col("label") == 1, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0]))
    drawn = told.where(F.pmod(F.xxhash64("l_fid", "r_fid", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).withColumn("weight", weight)
    stages = [VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), GBTClassifier(featuresCol="_x", labelCol="label", weightCol="weight", maxIter=15, maxDepth=3, seed=seed)]
    return Pipeline(stages=stages).fit(drawn)


def predicted(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """``pairs`` with p, the learned probability of a match."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(pairs)
    return out.select(*pairs.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def explained(model: PipelineModel, pairs: DataFrame, features: list[str]) -> DataFrame:
    """(l_fid, r_fid, feature, effect): how much p falls when a feature is set to 0, the largest first by the caller."""
    base = predicted(model, pairs.select("l_fid", "r_fid", *features)).select("l_fid", "r_fid", F.col("p").alias("_base"))
    out = None
    for f in features:
        without = predicted(model, pairs.select("l_fid", "r_fid", *[F.lit(0.0).alias(c) if c == f else F.col(c) for c in features]))
        rows = without.join(base, ["l_fid", "r_fid"]).select("l_fid", "r_fid", F.lit(f).alias("feature"), (F.col("_base") - F.col("p")).alias("effect"))
        out = rows if out is None else out.unionByName(rows)
    return out


def permutation_importance(model: PipelineModel, labelled: DataFrame, features: list[str], seed: int = 7) -> DataFrame:
    """(feature, importance): the area under the curve that is lost when a feature's values are dealt anew among the rows."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    judge = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label")
    rows = durable(labelled.select("l_fid", "r_fid", F.col("label").cast("double").alias("label"), *features))
    whole = judge.evaluate(model.transform(rows))
    order = lambda *c: F.row_number().over(Window.partitionBy("_part").orderBy(*c))
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("l_fid", "r_fid"), F.lit(64)))
    numbered = durable(parts.withColumn("_k", order("l_fid", "r_fid")).withColumn("_s", order(F.xxhash64("r_fid", "l_fid", F.lit(seed)), "l_fid", "r_fid")))
    found = []
    for f in features:
        dealt = numbered.drop(f).join(numbered.select("_part", F.col("_s").alias("_k"), f), ["_part", "_k"])
        found.append((f, float(whole - judge.evaluate(model.transform(dealt)))))
    return rows.sparkSession.createDataFrame(found, "feature string, importance double")
