"""Event feeds: windows with watermarks, sessions, subscriptions and keyed merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 days", time: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events, values and users per window and key; works on a stream and on a table alike."""
    at = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", size, slide) if slide else F.window("_t", size)
    out = at.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Stretches of a key's events without a pause longer than the gap."""
    at = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = at.groupBy(F.session_window("_t", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def deliveries(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event_id, sub_id) of the events each active subscription asks for: by type (an empty list is any), least value and area.

    ``subscriptions``: sub_id, event_types, least, active, and x1, y1, x2, y2
    where events have x and y; a null corner is no limit.  A subscription is
    joined by its types, one to all of them under a mark of its own, so a
    stream of events meets a table in an equi-join and needs no state.
    """
    boxed = _boxed(events, subscriptions)
    box = ["x1", "y1", "x2", "y2"] if boxed else []
    met = _offered(events).join(_asked(subscriptions, *box), "_t").where(F.col("value") >= F.col("least"))
    if boxed:
        inside = lambda low, v, high: F.coalesce(F.col(low) <= F.col(v), F.lit(True)) & F.coalesce(F.col(v) <= F.col(high), F.lit(True))
        met = met.where(inside("x1", "x", "x2") & inside("y1", "y", "y2"))
    return met.select("event_id", "sub_id")


def _boxed(events: DataFrame, subscriptions: DataFrame) -> bool:
    return {"x1", "y1", "x2", "y2"} <= set(subscriptions.columns) and {"x", "y"} <= set(events.columns)


def _asked(subscriptions: DataFrame, *more: str) -> DataFrame:
    """A row for each type of each active subscription."""
    types = F.when(F.size("event_types") > 0, F.array_distinct("event_types")).otherwise(F.array(F.lit("*")))
    return subscriptions.where("active").withColumn("_t", F.explode(types)).select("sub_id", "least", "_t", *more)


def _offered(events: DataFrame) -> DataFrame:
    """Each event by its type and by the mark of all types."""
    return events.withColumn("_t", F.explode(F.array_distinct(F.array(F.coalesce("event_type", F.lit("")), F.lit("*")))))


def delivery_counts(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(sub_id, n): how many ``deliveries`` each subscription gets that gets any.

    Without areas no pair is listed: the events of a type are counted by value,
    and a running count from the greatest value down stands at every least
    value asked for.  The running count is split into stretches of values, so a
    hot type is spread over tasks; the stretches need only follow the order of
    the values, which the logarithm does.  With areas the pairs are counted.
    """
    if _boxed(events, subscriptions):
        return deliveries(events, subscriptions).groupBy("sub_id").agg(F.count(F.lit(1)).alias("n"))
    asked = _asked(subscriptions).where("least IS NOT NULL")
    none = F.lit(0).cast("bigint")
    sent = _offered(events).select("_t", F.col("value").alias("_v"), F.lit(1).cast("bigint").alias("_n"), none.alias("_asked"))
    points = sent.where("_v IS NOT NULL").unionByName(asked.select("_t", F.col("least").alias("_v"), none.alias("_n"), F.lit(1).cast("bigint").alias("_asked")))
    v = F.col("_v").cast("double")
    stretch = F.when(F.isnan(v), F.lit(2**63 - 1)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * 64))
    points = points.groupBy("_t", "_v").agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked")).withColumn("_b", stretch)
    within = F.sum("_n").over(Window.partitionBy("_t", "_b").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.sum("_n").over(Window.partitionBy("_t").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
    later = points.groupBy("_t", "_b").agg(F.sum("_n").alias("_n")).select("_t", "_b", F.coalesce(above, none).alias("_above"))
    counted = points.withColumn("_n", within).where("_asked = 1").join(later.hint("merge"), ["_t", "_b"]).select("_t", F.col("_v").alias("least"), (F.col("_n") + F.col("_above")).alias("_n"))
    # Spark sizes subscriptions without the types they are spread over, and would broadcast them.
    return asked.hint("merge").join(counted, ["_t", "least"]).groupBy("sub_id").agg(F.sum("_n").alias("n")).where("n > 0")


def merge_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row of every key in a versioned Parquet table.

    Each batch writes the version ``v=<batch>`` from the newest one before it,
    so a batch that runs twice gives the same table, batch numbers may have
    gaps, and a reader of the version before is not disturbed.  Older versions
    are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = sorted(int(s.getPath().getName()[2:]) for s in files.listStatus(root) if s.getPath().getName().startswith("v=")) if files.exists(root) else []
        before = [v for v in known if v < number]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
        if before:
            both = spark.read.schema(batch.schema).parquet(f"{path}/v={before[-1]}").unionByName(last)
            last = both.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/v={number}")
        for old in before[:-1]:
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}"), True)

    return write
