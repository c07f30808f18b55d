"""Evidence of several sources about one property, fused and resolved.

Every claim is a simple support function: a mass on its value and the rest on
the whole frame.  Combining all of them without renormalising has a closed
form, so fusion is a two-level aggregation instead of a pairwise loop:
q_h is the product of (1 - m) over the claims of a value, q the product over
all values, and the mass of a value is (1 - q_h) * q / q_h before the final
division by the sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recency(observed: Column, as_of: Column, half_life: Column) -> Column:
    """0.5 to the power of age over half-life; 0.75 without a date; never above 1."""
    age = F.greatest(F.datediff(as_of, observed), F.lit(0))
    return F.coalesce(F.pow(F.lit(0.5), age / half_life), F.lit(0.75))


def accuracy_weight(accuracy: Column, tolerance: float = 1.0) -> Column:
    """Logistic weight of a positional accuracy against a tolerance; 0.5 without one."""
    return F.coalesce(1 / (1 + F.exp(1.9 * F.log10(accuracy / tolerance) - 0.85)), F.lit(0.5))


def mass(prior: Column, recent: Column, accurate: Column, corroboration: Column | float = 0.0, penalty: Column | float = 0.0) -> Column:
    """Evidence mass of a claim, between 0 and 0.995."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    raw = prior * (0.45 + 0.55 * recent) * (0.40 + 0.60 * accurate) * (1 + 0.35 * as_col(corroboration)) * (1 - F.least(as_col(penalty), F.lit(0.95)))
    return F.greatest(F.lit(0.0), F.least(raw, F.lit(0.995)))


def one_per_source(claims: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    """The last claim of every source about every property, by a total order."""
    return claims.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def fused(evidence: DataFrame, keys: list[str], value: str = "value", weight: str = "mass") -> DataFrame:
    """Mass, belief and plausibility of every value of every group, and the mass left on the frame."""
    by_value = evidence.groupBy(*keys, value).agg(F.product(1 - F.least(F.col(weight), F.lit(0.999))).alias("out_of"), F.count(F.lit(1)).alias("sources"))
    group = Window.partitionBy(*keys)
    open_ = by_value.withColumn("theta", F.product("out_of").over(group))
    raw = open_.withColumn("raw", (1 - F.col("out_of")) * F.col("theta") / F.col("out_of"))
    total = raw.withColumn("total", F.sum("raw").over(group) + F.col("theta"))
    return total.select(*keys, value, "sources", (F.col("raw") / F.col("total")).alias("belief"), ((F.col("raw") + F.col("theta")) / F.col("total")).alias("plausibility"))


def conflict_mass(evidence: DataFrame, keys: list[str], order: list[str], value: str = "value", weight: str = "mass") -> DataFrame:
    """The order-dependent conflict K of combining the claims one after the other.

    Folded in a higher-order aggregate over the sorted claims of a group; a
    group has at most one claim per source, so the array is bounded.
    """
    steps = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("h"), F.least(F.col(weight), F.lit(0.999)).alias("m"))))
    zero = F.struct(F.lit(0.0).alias("k"), F.lit(1.0).alias("theta"), F.expr("cast(map() as map<string,double>)").alias("acc"))

    def step(s: Column, c: Column) -> Column:
        own = F.coalesce(F.element_at(s["acc"], c["h"].cast("string")), F.lit(0.0))
        others = F.aggregate(F.map_values(s["acc"]), F.lit(0.0), lambda a, b: a + b) - own
        clash = c["m"] * others
        kept = F.transform_values(s["acc"], lambda h, v: F.when(h == c["h"].cast("string"), v + c["m"] * s["theta"]).otherwise(v * (1 - c["m"])))
        first = F.map_filter(F.create_map(c["h"].cast("string"), c["m"] * s["theta"]), lambda h, v: ~F.map_contains_key(s["acc"], h))
        return F.struct((s["k"] + clash - s["k"] * clash).alias("k"), (s["theta"] * (1 - c["m"])).alias("theta"), F.map_concat(kept, first).alias("acc"))

    return evidence.groupBy(*keys).agg(F.aggregate(steps, zero, step)["k"].alias("conflict"))


def resolved(evidence: DataFrame, keys: list[str], value: str = "value", weight: str = "mass") -> DataFrame:
    """One decision per group: value, belief, plausibility, strategy.

    A single claim stands with its mass; unanimous claims stand; otherwise the
    value of most belief wins, the smaller value of equals.  A group whose
    belief is below 0.40 or whose gap to plausibility is above 0.45 is marked
    for a person to decide.
    """
    f = fused(evidence, keys, value, weight)
    best = f.groupBy(*keys).agg(F.min_by(F.struct(value, "belief", "plausibility"), F.struct(F.negative("belief"), value)).alias("b"), F.count(F.lit(1)).alias("options"), F.sum("sources").alias("claims"))
    single, unanimous = F.col("claims") == 1, F.col("options") == 1
    belief = F.when(unanimous & ~single, 1.0).otherwise(F.col("b.belief"))
    plausibility = F.when(unanimous, 1.0).otherwise(F.col("b.plausibility"))
    strategy = F.when(single, "single_source").when(unanimous, "unanimous").otherwise("fusion")
    escalate = ~unanimous & ((belief < 0.40) | (plausibility - belief > 0.45))
    return best.select(*keys, F.col(f"b.{value}").alias(value), belief.alias("belief"), plausibility.alias("plausibility"), "options", "claims", strategy.alias("strategy"), escalate.alias("escalated"))


def entropy(masses: Column) -> Column:
    """Shannon entropy in bits of an array of masses; masses of 0 add nothing."""
    return F.aggregate(F.filter(masses, lambda m: m > 0), F.lit(0.0), lambda a, m: a - m * F.log2(m))
