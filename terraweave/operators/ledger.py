"""Hash-chained ledgers and Merkle trees.

Building a chain is a fold over all entries and therefore sequential; it runs
per batch of appended entries from the last hash.  Verifying needs only the
predecessor's hash and is one window; a Merkle root needs a logarithm of
rounds, each one aggregation over pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.session import durable

GENESIS = "0" * 64


def entry_hash(index: Column, payload: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", index.cast("string"), payload, previous), 256)


def chained(entries: DataFrame, last: str = GENESIS) -> DataFrame:
    """(index, payload, prev_hash, entry_hash) of a batch of new entries after the hash ``last``.

    Each hash needs the one before, so the batch, which is what one run
    appends and not the ledger, passes through one task in the order of its
    index; the task keeps one hash and no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = last
        for batch in batches:
            before, own = [], []
            for index, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before.append(previous)
                # Nulls are left out, as in entry_hash.
                previous = hashlib.sha256("|".join(p for p in (None if index is None else str(index), payload, previous) if p is not None).encode()).hexdigest()
                own.append(previous)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.string()), pa.array(own, pa.string())], names=["index", "payload", "prev_hash", "entry_hash"])

    ordered = entries.select(F.col("index").cast("bigint").alias("index"), "payload").repartition(1).sortWithinPartitions("index", "payload")
    return ordered.mapInArrow(run, "index bigint, payload string, prev_hash string, entry_hash string")


def verified(chain: DataFrame, first: str = GENESIS) -> DataFrame:
    """Add ``holds``: the entry's hash is right and its predecessor's hash is the one it names.

    The predecessor is found by a join on the index, so the check is spread
    over the cluster and no window runs over the whole ledger.
    """
    before = chain.select((F.col("index") + 1).alias("index"), F.col("entry_hash").alias("_before"))
    lowest = chain.agg(F.min("index").alias("_first"))
    # One row by construction.
    joined = chain.join(before, "index", "left").join(F.broadcast(lowest))
    previous = F.when(F.col("index") == F.col("_first"), F.lit(first)).otherwise(F.col("_before"))
    holds = (F.col("prev_hash") == previous) & (F.col("entry_hash") == entry_hash(F.col("index"), F.col("payload"), F.col("prev_hash")))
    return joined.withColumn("holds", F.coalesce(holds, F.lit(False))).drop("_before", "_first")


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels of the tree from the leaves (index from 0, hash) to the root; an odd node is paired with itself."""
    n = leaves.count()
    level, levels = leaves.select(F.col("index").cast("bigint").alias("index"), "hash"), []
    levels.append(level)
    while n > 1:
        pairs = level.groupBy(F.floor(F.col("index") / 2).alias("index")).agg(F.min_by("hash", "index").alias("a"), F.max_by("hash", "index").alias("b"))
        level = durable(pairs.select("index", F.sha2(F.concat("a", "b"), 256).alias("hash")))
        levels.append(level)
        n = -(-n // 2)
    return levels


def merkle_root(leaves: DataFrame) -> DataFrame:
    ranked = leaves.withColumn("index", F.col("index") - leaves.agg(F.min("index")).first()[0]) if not leaves.isEmpty() else leaves
    return merkle_levels(ranked)[-1].select(F.col("hash").alias("root"))


def inclusion_proof(leaves: DataFrame, index: int) -> list[tuple[str, bool]]:
    """The sibling hashes from a leaf to the root, with whether each stands right: a logarithm of rows."""
    proof = []
    for level in merkle_levels(leaves)[:-1]:
        other = index ^ 1
        rows = level.where(F.col("index").isin(index, other)).collect()
        by = {r["index"]: r["hash"] for r in rows}
        proof.append((by.get(other, by[index]), other > index))
        index //= 2
    return proof


def proof_holds(leaf: str, proof: list[tuple[str, bool]], root: str) -> bool:
    for sibling, right in proof:
        leaf = hashlib.sha256((leaf + sibling if right else sibling + leaf).encode()).hexdigest()
    return leaf == root
