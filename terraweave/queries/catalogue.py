"""All core queries by name, and the SQL twins of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraweave.queries import basics, evidence, fabric, feeds, ground, identity, joins, linkage, measures, problems, records, resolution, scalars, serving

MODULES = [problems, ground, identity, joins, evidence, resolution, fabric, records, linkage, measures, scalars, basics, feeds, serving]

FLAGSHIP = problems.p3_found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
