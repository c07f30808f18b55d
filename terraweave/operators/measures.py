"""Quality measures of layers: accuracy, autocorrelation, completeness, confidence, rollups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.operators.grid import nearest_join
from terraweave.operators.quantiles import exact_quantiles
from terraweave.session import durable

WEIGHTS = {"placement": 0.28, "agreement": 0.22, "topological": 0.18, "completeness": 0.14, "currency": 0.10, "lineage": 0.08}


def accuracy_assessment(checks: DataFrame, spec: float = 1.0) -> DataFrame:
    """RMSE, CE90, CE95, bias and scatter of check points after rejection of blunders.

    ``checks``: dx, dy.  Blunders lie more than three scaled deviations from
    the median and are rejected where there are ten points or more.  An empty
    table gives one row with counts of 0 and nulls.
    """
    d = durable(checks.select("dx", "dy", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("r")))
    middle = exact_quantiles(d, m=("r", 0.5)).join(F.broadcast(d.agg(F.count(F.lit(1)).alias("n_all"))))
    # One row of statistics against the points: its size is one by construction.
    centred = d.join(F.broadcast(middle)).withColumn("dev", F.abs(F.col("r") - F.col("m")))
    scale = exact_quantiles(centred, dev_m=("dev", 0.5)).select((F.col("dev_m") * 1.4826).alias("s"))
    kept = centred.join(F.broadcast(scale)).where((F.col("n_all") < 10) | (F.col("s") == 0) | (F.col("dev") <= 3 * F.col("s")))
    rmse = F.sqrt(F.avg(F.col("r") * F.col("r")))
    bias = F.sqrt(F.avg("dx") * F.avg("dx") + F.avg("dy") * F.avg("dy"))
    sums = kept.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("dx") * F.col("dx"))).alias("rmse_x"), F.sqrt(F.avg(F.col("dy") * F.col("dy"))).alias("rmse_y"), rmse.alias("rmse"),
        (rmse * 1.7308).alias("nssda"), bias.alias("bias"), F.sqrt(F.greatest(rmse * rmse - bias * bias, F.lit(0.0))).alias("scatter"),
    )
    return sums.join(F.broadcast(exact_quantiles(kept, ce90=("r", 0.9), ce95=("r", 0.95)))).withColumn("within_spec", F.col("ce95") <= spec)


def morans_i(points: DataFrame, value: str, cell: float, k: int = 6) -> DataFrame:
    """Moran's I over the k nearest neighbours within a cell size, in both directions."""
    at = points.select("fid", "x", "y")
    near = nearest_join(at, at, cell, k + 1).where("l_fid <> r_fid").select("l_fid", "r_fid", F.col("distance"))
    order = Window.partitionBy("l_fid").orderBy("distance", "r_fid")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    links = near.select("l_fid", "r_fid").unionByName(near.select(F.col("r_fid").alias("l_fid"), F.col("l_fid").alias("r_fid"))).distinct()
    mean = points.agg(F.avg(value).alias("mean"))
    z = points.join(F.broadcast(mean)).select("fid", (F.col(value) - F.col("mean")).alias("z"))
    square = z.agg(F.sum(F.col("z") * F.col("z")).alias("ss"), F.count(F.lit(1)).alias("n"))
    cross = links.join(z.toDF("l_fid", "zl"), "l_fid").join(z.toDF("r_fid", "zr"), "r_fid").agg(F.sum(F.col("zl") * F.col("zr")).alias("cross"), F.count(F.lit(1)).alias("w"))
    return square.join(F.broadcast(cross)).select("n", "w", (F.col("n") / F.col("w") * F.col("cross") / F.col("ss")).alias("moran"))


def composite(columns: dict[str, float] = WEIGHTS) -> Column:
    """Weighted confidence of six dimensions; a missing dimension counts 0.5, others are cut to 0..1."""
    clean = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.5))))
    return sum((clean(c) * w for c, w in columns.items()), F.lit(0.0))


def grade(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "A").when(confidence >= 0.75, "B").when(confidence >= 0.6, "C").when(confidence >= 0.4, "D").otherwise("E")


def weakest(columns: dict[str, float] = WEIGHTS) -> Column:
    """Name of the smallest dimension, the first by name of equals."""
    return F.array_min(F.array(*[F.struct(F.coalesce(F.col(c), F.lit(0.5)).alias("v"), F.lit(c).alias("k")) for c in columns]))["k"]


def completeness(matched: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Matched, omission, commission, completeness, correctness and F1 of a layer against a reference."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = n(matched, "matched").join(F.broadcast(n(left, "reference"))).join(F.broadcast(n(right, "tested")))
    p, r = F.col("matched") / F.nullif(F.col("tested"), F.lit(0)), F.col("matched") / F.nullif(F.col("reference"), F.lit(0))
    return row.select("matched", (F.col("reference") - F.col("matched")).alias("omission"), (F.col("tested") - F.col("matched")).alias("commission"), r.alias("completeness"), p.alias("correctness"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def functional_dependencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of columns (determinant, dependent) where each value of the first has one value of the second."""
    cells = df.select(*columns)
    parts = []
    for a in columns:
        # All dependents of one determinant share its grouping.
        most = cells.where(F.col(a).isNotNull()).groupBy(a).agg(*[F.coalesce((F.min(b) != F.max(b)).cast("int"), F.lit(0)).alias(b) for b in columns if b != a])
        worst = most.agg(*[F.max(b).alias(b) for b in columns if b != a])
        parts.append(worst.select(F.lit(a).alias("determinant"), F.explode(F.array(*[F.struct(F.lit(b).alias("dependent"), F.col(b).alias("bad")) for b in columns if b != a])).alias("d")).where("d.bad = 0").select("determinant", "d.dependent"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def jensen_shannon(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of two weighted distributions over the same key."""
    # The total is one row against the keys.
    share = lambda df, n: df.groupBy(key).agg(F.sum("n").alias("n")).join(F.broadcast(df.agg(F.sum("n").alias("_all")))).select(key, (F.col("n") / F.col("_all")).alias(n))
    both = share(a, "p").join(share(b, "q"), key, "full_outer").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return both.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.sum(part("p")) + F.sum(part("q"))) / 2)).alias("divergence"))


def bigram_counts(texts: DataFrame, group: str, text: str) -> DataFrame:
    """(group, gram, n) of the neighbouring signs of whole texts, counted in Arrow batches before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, names = pc.dictionary_encode(batch.column(0), null_encoding="encode"), None
            names = code.dictionary
            size = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            signs = np.frombuffer("".join(t for t in batch.column(1).to_pylist() if t).encode("utf-32-le"), np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            pair = (signs[:-1] << 21) | signs[1:]
            of = code.indices.to_numpy(zero_copy_only=False)[owner[:-1]] if len(owner) else np.zeros(0, np.int64)
            within = owner[1:] == owner[:-1]
            for k in range(len(names)):
                grams, n = np.unique(pair[within & (of == k)], return_counts=True)
                flat = np.column_stack([grams >> 21, grams & 0x1FFFFF]).astype(np.uint32).tobytes().decode("utf-32-le")
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(grams), k))), pa.array([flat[2 * i : 2 * i + 2] for i in range(len(grams))], pa.string()), pa.array(n)], names=[group, "gram", "n"])

    counted = texts.select(group, text).mapInArrow(run, f"{group} {dict(texts.dtypes)[group]}, gram string, n bigint")
    return counted.groupBy(group, "gram").agg(F.sum("n").alias("n"))


def divergence_from_rest(counts: DataFrame, group: str, key: str) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of the counts ``n`` of every group from those of all other groups; null without others.

    Keys that a group lacks enter by their sum, so no group is crossed with all keys.
    """
    total = counts.groupBy(key).agg(F.sum("n").alias("t"))
    # The total is one row against the groups.
    sizes = counts.groupBy(group).agg(F.sum("n").alias("g")).join(F.broadcast(counts.agg(F.sum("n").alias("all"))))
    own = counts.join(total, key).join(sizes.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
    p, q = F.col("n") / F.col("g"), (F.col("t") - F.col("n")) / F.nullif(F.col("all") - F.col("g"), F.lit(0))
    m = (p + q) / 2
    part = p * F.log2(p / m) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    # A key of the others only adds q * log2(q / (q / 2)) = q.
    summed = own.groupBy(group).agg(F.sum(part).alias("s"), F.sum(q).alias("q"))
    return summed.select(group, F.when(F.col("q").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("s") + 1 - F.col("q")) / 2))).alias("divergence"))
