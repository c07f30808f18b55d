"""Exact quantiles of a whole table without gathering its values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketch that brackets a quantile: what lies in a bracket is about four rows in this many.
ACCURACY = 100_000


def exact_quantiles(df: DataFrame, **wanted: tuple[str, float]) -> DataFrame:
    """One row with a column for each ``name=(column, quantile)``, interpolated between neighbours; null without values.

    A sketch gives a bracket around each quantile; a second pass counts what
    lies below it and keeps only what lies in it, the next value on either
    side included, so the values in between are a small share of the rows
    whatever their number.
    """
    step = 2.0 / ACCURACY
    ends = [F.percentile_approx(column, F.array(F.lit(max(0.0, q - step)), F.lit(min(1.0, q + step))), ACCURACY).alias(f"_{name}") for name, (column, q) in wanted.items()]
    # One row of brackets against the rows.
    at = df.select(*{c for c, _ in wanted.values()}).join(F.broadcast(df.agg(*ends)))
    parts = []
    for name, (column, _) in wanted.items():
        v, low, high = F.col(column), F.get(f"_{name}", F.lit(0)), F.get(f"_{name}", F.lit(1))
        parts += [
            F.count(v).alias(f"n_{name}"), F.count_if(v < low).alias(f"below_{name}"), F.max(F.when(v < low, v)).alias(f"before_{name}"), F.min(F.when(v > high, v)).alias(f"after_{name}"),
            F.sort_array(F.collect_list(F.when((v >= low) & (v <= high), v))).alias(f"in_{name}"),
        ]
    row = at.agg(*parts)

    def quantile(name: str, q: float):
        n, below, inside = F.col(f"n_{name}"), F.col(f"below_{name}"), F.col(f"in_{name}")
        place = (n - 1) * q
        value = lambda k: F.when(k < below, F.col(f"before_{name}")).when(k - below >= F.size(inside), F.col(f"after_{name}")).otherwise(F.get(inside, (k - below).cast("int")))
        low = F.floor(place)
        first, second = value(low), value(low + 1)
        share = place - low
        return F.when(n > 0, F.when(share == 0, first).otherwise(first + (second - first) * share)).alias(name)

    return row.select(*[quantile(name, q) for name, (_, q) in wanted.items()])
