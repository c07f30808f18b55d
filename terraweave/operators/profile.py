"""Column-level data quality profile.

Method: declared expectations (one row per dataset and attribute) are compiled
into one shared aggregate scan.  The scan keeps mergeable states only: counts,
sums, extremes and sketches.  States of loads, files or days are stored and
added up later without reading the rows again; departures are judged on the
merged states, against the declared expectation or against control limits of
the history of the same metric.

The scan aggregates twice: first by value, which makes distinct counts exact
within what is scanned at once and lets each value's number and pattern enter
weighted, then by attribute.  Whether a median exceeds a limit is decided from
how many values do and from the two values next to the limit.  Only distinct
counts of merged states are estimates, from sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.functions.values import squeezed
from terraweave.session import durable

#: Expectations up to this number are compiled into the scan; more are joined to it.
MOST_COMPILED = 5_000

GEOMETRY = "geom"
_NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\z"


def decimal_digits(v: Column) -> Column:
    """Digits after the point in the shortest decimal text of a double."""
    text = v.cast("string")
    fraction = F.rtrim(F.substring_index(F.substring_index(text, "E", 1), ".", -1), F.lit("0"))
    shift = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
    return F.greatest(F.lit(0), F.length(fraction) - shift)


def coordinate_digits(geom: Column) -> Column:
    """The most decimal digits in any coordinate of a geometry; null without one."""
    numbers = F.flatten(F.transform(F.flatten(geom["rings"]), lambda p: F.array(p["x"], p["y"])))
    return F.array_max(F.transform(F.filter(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e15)), decimal_digits))


def long_values(features: DataFrame, load: list[str], properties: str = "properties") -> DataFrame:
    """(load, attribute, value) of every property that is there, is not null and not blank."""
    pairs = features.select(*load, F.explode(F.col(properties)).alias("attribute", "value"))
    return pairs.where(squeezed(F.col("value")) != "")


def _compiled(rules: list, column: str, condition: str = "attribute") -> Column:
    """A CASE over (dataset, attribute) from ``(dataset, attribute, expression)`` rules."""
    out = None
    by_dataset: dict[str, list] = {}
    for dataset, attribute, expression in rules:
        by_dataset.setdefault(dataset, []).append((attribute, expression))
    for dataset, own in by_dataset.items():
        inner = None
        for attribute, expression in own:
            test = F.col(condition) == attribute
            inner = F.when(test, expression) if inner is None else inner.when(test, expression)
        test = F.col(column) == dataset
        out = F.when(test, inner) if out is None else out.when(test, inner)
    return out if out is not None else F.lit(None)


def _told(values: DataFrame, profile: DataFrame) -> DataFrame:
    """``values`` with the pattern outcome ``_match`` and the expected median ``_middle`` of their attribute.

    Up to MOST_COMPILED expectations become CASE expressions of the scan; more
    are joined to it, with the same result.
    """
    rules = profile.where("attribute is not null and (value_pattern is not null or value_median is not null)").select("dataset_id", "attribute", "value_pattern", "value_median")
    some = rules.limit(MOST_COMPILED + 1).collect()
    if len(some) > MOST_COMPILED:
        own = rules.select(F.col("dataset_id").alias("_d"), F.col("attribute").alias("_a"), "value_pattern", F.col("value_median").alias("_middle"))
        joined = values.join(own, (F.col("dataset_id") == F.col("_d")) & (F.col("attribute") == F.col("_a")), "left")
        match = F.rlike(F.col("value"), F.concat(F.lit("^(?:"), "value_pattern", F.lit(")\\z"))).cast("int")
        return joined.select(*values.columns, match.alias("_match"), F.col("_middle").cast("double").alias("_middle"))
    match = _compiled([(r["dataset_id"], r["attribute"], F.col("value").rlike(f"^(?:{r['value_pattern']})\\z").cast("int")) for r in some if r["value_pattern"] is not None], "dataset_id").cast("int")
    middle = _compiled([(r["dataset_id"], r["attribute"], F.lit(float(r["value_median"]))) for r in some if r["value_median"] is not None], "dataset_id").cast("double")
    return values.select("*", match.alias("_match"), middle.alias("_middle"))


_SUMS = ("n", "n_match", "numbers", "above", "below")
_MINS = ("least", "over_hi", "over_lo")
_MAXS = ("most", "under_hi", "under_lo", "digits")


def profile_states(features: DataFrame, profile: DataFrame, load: list[str]) -> DataFrame:
    """Mergeable states of every (load, attribute) that has a value, and of every load, in one scan.

    The row of the load itself has a null attribute; its n counts the rows and
    its digits are the most of any coordinate.  States: n (values), n_match,
    numbers, least, most, and for the limits at half and twice the expected
    median how many numbers lie beyond and the numbers next to the limit;
    n_distinct (exact) and a sketch of the distinct values.
    """
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    stated = F.filter(F.map_entries("properties"), lambda e: squeezed(e["value"]) != "")
    rows = features.select(*load, coordinate_digits(F.col(GEOMETRY)).alias("digits"), F.concat(none, F.coalesce(stated, F.slice(none, 1, 0))).alias("_e"))
    values = rows.select(*load, "digits", F.explode("_e").alias("_v")).select(*load, F.col("_v.key").alias("attribute"), F.col("_v.value").alias("value"), F.when(F.col("_v.key").isNull(), F.col("digits")).alias("digits"))
    told = _told(values, profile)
    number = F.when(F.col("_middle").isNotNull() & F.trim("value").rlike(_NUMBER), F.trim("value").try_cast("double"))
    hashes = (F.when(F.col("value").isNotNull(), F.xxhash64("value")).alias("_h"), F.when(F.col("value").isNotNull(), F.hash("value")).alias("_g"))
    by_value = told.select(*load, "attribute", *hashes, "_match", number.alias("_x"), "_middle", "digits").groupBy(*load, "attribute", "_h", "_g")
    counted = by_value.agg(F.count(F.lit(1)).alias("c"), *[F.max(m).alias(m) for m in ("_match", "_x", "_middle", "digits")])
    x, c, hi, lo = F.col("_x"), F.col("c"), F.col("_middle") * 2, F.col("_middle") / 2
    return counted.groupBy(*load, "attribute").agg(
        F.sum(c).alias("n"),
        F.sum(c * F.col("_match")).alias("n_match"),
        F.coalesce(F.sum(F.when(x.isNotNull(), c)), F.lit(0)).alias("numbers"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.sum(F.when(x.isNotNull(), F.when(x > hi, c).otherwise(0))).alias("above"),
        F.max(F.when(x <= hi, x)).alias("under_hi"),
        F.min(F.when(x > hi, x)).alias("over_hi"),
        F.sum(F.when(x.isNotNull(), F.when(x < lo, c).otherwise(0))).alias("below"),
        F.max(F.when(x < lo, x)).alias("under_lo"),
        F.min(F.when(x >= lo, x)).alias("over_lo"),
        F.max("digits").alias("digits"),
        F.count("_h").alias("n_distinct"),
        F.hll_sketch_agg("_h").alias("sketch"),
    )


def merged_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """States added up over all that share ``keys`` (of which attribute is one): days to loads, loads to datasets.

    n_distinct of several states is the estimate of their united sketches.
    States of one attribute may only be merged if they were scanned against
    the same expectation.
    """
    whole = states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _SUMS], *[F.min(c).alias(c) for c in _MINS], *[F.max(c).alias(c) for c in _MAXS],
        F.count(F.lit(1)).alias("_parts"), F.max("n_distinct").alias("_d"), F.hll_union_agg("sketch").alias("sketch"),
    )
    distinct = F.when(F.col("_parts") == 1, F.col("_d")).otherwise(F.hll_sketch_estimate("sketch"))
    return whole.withColumn("n_distinct", distinct).select(*keys, *[c for c in states.columns if c in {*_SUMS, *_MINS, *_MAXS}], "n_distinct", "sketch")


def store_states(states: DataFrame, path: str, load: list[str]) -> DataFrame:
    """Add the states of new loads to the table at ``path`` and return the whole table.

    A load that is scanned again replaces its states; other loads stay, and
    their rows are not read.
    """
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*load).parquet(path)
    return states.sparkSession.read.schema(states.select(*[c for c in states.columns if c not in load], *load).schema).parquet(path).select(*states.columns)


def median_beyond(n: Column, beyond: Column, near: Column, far: Column, limit: Column, above: bool) -> Column:
    """Whether the median lies strictly beyond a limit, from counts and the two values around it."""
    straddles = (near + far) / 2 > limit if above else (near + far) / 2 < limit
    return F.when(beyond * 2 == n, straddles).otherwise(beyond * 2 > n)


def profile_of(states: DataFrame, profile: DataFrame, load: list[str]) -> DataFrame:
    """The profile of every attribute of every load from its states, expected ones that never occur included."""
    loads = states.where("attribute is null").select(*load, F.col("n").alias("rows"), F.col("digits").alias("_digits"))
    declared = profile.where("attribute is not null").select(F.col("dataset_id").alias("_d"), "attribute").distinct()
    own = states.where("attribute is not null")
    wanted = loads.join(declared, F.col("dataset_id") == F.col("_d")).select(*load, "attribute").unionByName(own.select(*load, "attribute")).distinct()
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}")) for c in load]
    joined = wanted.alias("w").join(loads.alias("s"), same).select("w.*", "s.rows", "s._digits")
    renamed = own.select(*[F.col(c).alias(f"_{c}") for c in load], F.col("attribute").alias("_a"), *[c for c in states.columns if c not in load and c not in ("attribute", "digits")])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in load] + [F.col("attribute") == F.col("_a")]
    out = joined.join(renamed, on, "left").drop("_a", *[f"_{c}" for c in load])
    geometry = F.col("attribute") == GEOMETRY
    n = F.coalesce("n", F.lit(0))
    return out.select(
        *load,
        "attribute",
        "rows",
        n.alias("values"),
        F.when(~geometry, 1 - n / F.col("rows")).alias("null_rate"),
        "n_distinct",
        (F.col("n_match") / n).alias("pattern_share"),
        F.when(geometry, F.col("_digits")).alias("digits"),
        *["numbers", "least", "most", "above", "under_hi", "over_hi", "below", "under_lo", "over_lo"],
    )


def profile_loads(features: DataFrame, profile: DataFrame, load: list[str]) -> DataFrame:
    """The profile of every attribute of every load, expected ones that never occur included.

    One row per load and attribute: rows, values, null_rate, n_distinct,
    pattern_share, extremes of declared numbers, and coordinate digits on
    ``geom``.  The features are scanned once; the states, a row per load and
    attribute, are stored and read by all that follows.  A load without any
    feature has no row; an empty table gives no rows.
    """
    return profile_of(durable(profile_states(features, profile, load)), profile, load)


def departures(profiled: DataFrame, profile: DataFrame, load: list[str], least_rows: int = 20) -> DataFrame:
    """(load, attribute, measure) where a load departs from its dataset's expectation."""
    e = profile.select(F.col("dataset_id").alias("_d"), F.col("attribute").alias("_a"), *[F.col(c).alias(f"e_{c}") for c in profile.columns if c not in ("dataset_id", "attribute")])
    joined = profiled.where(F.col("rows") >= least_rows).join(e, (F.col("dataset_id") == F.col("_d")) & (F.col("attribute") == F.col("_a")))
    property_ = F.col("attribute") != GEOMETRY
    median = F.col("e_value_median")
    high = median_beyond(F.col("numbers"), F.col("above"), F.col("under_hi"), F.col("over_hi"), median * 2, True)
    low = median_beyond(F.col("numbers"), F.col("below"), F.col("over_lo"), F.col("under_lo"), median / 2, False)
    measures = {
        "null_rate": property_ & (F.abs(F.col("null_rate") - F.col("e_attribute_null_rate")) > 0.25),
        "cardinality": property_ & (F.col("e_attribute_cardinality") == F.col("e_feature_count")) & (F.col("values") > 0) & (F.col("n_distinct") < 0.75 * F.col("values")),
        "pattern": property_ & (F.col("values") > 0) & (F.col("e_pattern_share") - F.col("pattern_share") > 0.15),
        "distribution": property_ & (F.col("numbers") > 0) & (high | low),
        "precision": ~property_ & (F.col("e_coordinate_precision_digits") - F.col("digits") >= 2),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in measures.items()]))
    return joined.select(*load, "attribute", F.explode(found).alias("measure"))


def control_limits(metrics: DataFrame, keys: list[str], order: str, value: str, sigmas: float = 3.0, least_history: int = 5) -> DataFrame:
    """Anomalies of a metric against control limits of its own history.

    Adds mean, deviation and ``out_of_control`` from the rows of the same key
    that come before in ``order``; rows with fewer than ``least_history``
    predecessors are never out of control.
    """
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = metrics.select("*", F.avg(value).over(past).alias("history_mean"), F.stddev_samp(value).over(past).alias("history_deviation"), F.count(value).over(past).alias("history_n"))
    test = (F.col("history_n") >= least_history) & (F.abs(F.col(value) - F.col("history_mean")) > sigmas * F.col("history_deviation"))
    return out.withColumn("out_of_control", F.coalesce(test, F.lit(False)))
