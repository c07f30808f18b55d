"""Extension points: labelling functions, rules, comparators and connectors by name.

Each registry holds functions that make or take columns and DataFrames, so what
is added runs where the built-in ones do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """Named functions in the order in which they were added."""

    def __init__(self, kind: str):
        self.kind, self._entries = kind, {}

    def add(self, name: str) -> Callable[[Callable], Callable]:
        """Decorator that adds a function; a name that is taken is an error."""

        def keep(function: Callable) -> Callable:
            if name in self._entries:
                raise ValueError(f"{self.kind} {name} is there already")
            self._entries[name] = function
            return function

        return keep

    def __getitem__(self, name: str) -> Callable:
        if name not in self._entries:
            raise KeyError(f"no {self.kind} {name}; known: {', '.join(self._entries)}")
        return self._entries[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def discard(self, name: str) -> None:
        self._entries.pop(name, None)


#: () -> Column: 1 match, 0 no match, null no opinion.
LABELLING_FUNCTIONS = Registry("labelling function")
#: () -> Column: whether a row breaks the rule.
RULES = Registry("rule")
#: (Column, Column) -> Column: similarity of two values, 0 to 1.
COMPARATORS = Registry("comparator")
#: (SparkSession, path, dataset_id) -> DataFrame of dataset_id, fid, geom, properties.
CONNECTORS = Registry("connector")


def labelled(pairs: DataFrame) -> DataFrame:
    """``pairs`` with a column for the opinion of each labelling function and ``label``, the unanimous one or -1."""
    opinions = {name: LABELLING_FUNCTIONS[name]().cast("int") for name in LABELLING_FUNCTIONS}
    given = F.array_distinct(F.array_compact(F.array(*opinions.values()))) if opinions else F.array().cast("array<int>")
    return pairs.select("*", *[c.alias(f"says_{n}") for n, c in opinions.items()], F.when(F.size(given) == 1, F.get(given, F.lit(0))).otherwise(-1).alias("label"))


def broken_rules(df: DataFrame, out: str = "broken") -> DataFrame:
    """``df`` with the names of the rules each row breaks, in their order."""
    tests = [F.when(F.coalesce(RULES[name](), F.lit(False)), F.lit(name)) for name in RULES]
    return df.withColumn(out, F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def compared(a: Column, b: Column, name: str) -> Column:
    return COMPARATORS[name](a, b)


def read(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """Read a path with the connector of its extension, one that was added before the built-in ones."""
    from terraweave.sources.readers import read_path

    plain = path.removesuffix(".gz")
    for extension in CONNECTORS:
        if plain.endswith(extension):
            return CONNECTORS[extension](spark, path, dataset_id)
    return read_path(spark, path, dataset_id)
