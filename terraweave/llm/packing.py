"""Items packed into containers of fixed capacity.

Method: a grouping genetic algorithm on islands.  A solution is a set of bins;
crossover injects whole well-filled bins of one parent into another one,
removes the bins that hold a document twice, lets displaced documents replace
smaller ones where that fills a bin better, and best-fits what is left.  The
items are dealt into blocks of bounded size; every block is evolved by several
islands from different beginnings, the elites migrate to the next island of
the block between the epochs, and the best solution of a block stands.  Blocks
at the lower bound are left alone.

What the worst-filled bins of all blocks hold goes into the next round of
fewer, freshly dealt blocks.  Where little settles, the round is repeated with
the whole search in every block; only if little settles then too, all bins stand
but the emptiest, whose items are about one block.  So no bin below FULL stands
without the whole search, every specification ends in a single block, and no
space is lost to the borders between blocks but what bins of FULL or more leave
and what the whole search could not gain.

A document larger than the container is split into full parts and a rest; the
full parts fill containers of their own and only the rest is packed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.session import durable

#: Items of a block.
BLOCK = 2048
EPOCHS = 2
#: Islands of a block, solutions of an island, generations of an epoch and how many of them may pass without gain: in blocks
#: whose rest goes on to the next round, and (the whole search) in blocks whose bins may stand below FULL.
PASSING = {"islands": 2, "population": 6, "generations": 12, "patience": 4}
LAST = {"islands": 4, "population": 16, "generations": 400, "patience": 120}
#: Bins emptier than this share go into the next round.
FULL = 0.995
#: After a round in which more than this share of the items stays every block has the whole search; after such a round with the
#: whole search only the emptiest bins go on.
LITTLE = 0.7


def best_fit(sizes: list[int], capacity: int, order: list[int], bins: list[list[int]] | None = None) -> list[list[int]]:
    """Each item into the fullest bin that still holds it, in the given order."""
    bins = [] if bins is None else bins
    _fitted(sizes, capacity, order, bins, [sum(sizes[i] for i in b) for b in bins])
    return bins


def _fitted(sizes: list[int], capacity: int, order: list[int], bins: list[list[int]], sums: list[int]) -> None:
    """``best_fit`` in place, with the sums of the bins."""
    room = sorted((capacity - s, k) for k, s in enumerate(sums))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            sums.append(sizes[i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            sums[k] += sizes[i]
            insort(room, (left - sizes[i], k))


def _fitness(capacity: int, sums: list[int]) -> float:
    """Mean square of the fill: of two solutions with as many bins the less even one is better."""
    fill = np.array(sums, float) / capacity
    return float(fill @ fill) / max(1, len(sums))


def fitness(sizes: list[int], capacity: int, bins: list[list[int]]) -> float:
    return _fitness(capacity, [sum(sizes[i] for i in b) for b in bins])


def _replaced(sizes: list[int], capacity: int, bins: list[list[int]], sums: list[int], loose: list[int]) -> list[int]:
    """Let loose items replace one or two smaller ones of a bin where that fills it better; returns what is loose then."""
    loose = sorted(loose, key=sizes.__getitem__)
    weights = [sizes[i] for i in loose]
    for n, b in enumerate(bins):
        room = capacity - sums[n]
        if room == 0 or not loose:
            continue
        own = [sizes[i] for i in b]
        gain, pick, where = 0, (), 0
        for k, w in enumerate(own):
            at = bisect_right(weights, w + room) - 1
            if at >= 0 and weights[at] - w > gain:
                gain, pick, where = weights[at] - w, (k,), at
            if gain == room:
                break
            for m in range(min(k, 12)):
                gone = w + own[m]
                at = bisect_right(weights, gone + room) - 1
                if at >= 0 and weights[at] - gone > gain:
                    gain, pick, where = weights[at] - gone, (k, m), at
        if gain:
            freed = [b[k] for k in pick]
            b[:] = [i for k, i in enumerate(b) if k not in pick] + [loose.pop(where)]
            weights.pop(where)
            sums[n] += gain
            for i in freed:
                at = bisect_right(weights, sizes[i])
                weights.insert(at, sizes[i])
                loose.insert(at, i)
    return loose


def _crossed(sizes: list[int], capacity: int, one: list[list[int]], sums_one: list[int], two: list[list[int]], sums_two: list[int], rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    fill = np.array(sums_one, float) / capacity
    good = np.flatnonzero((fill >= min(FULL, float(np.median(fill)))) & (rng.random(len(one)) < 0.4))
    child, sums = [list(one[k]) for k in good], [sums_one[k] for k in good]
    taken = {i for b in child for i in b}
    # Some of the emptiest and of all kept bins are opened too, so that their items can move.
    kept = [k for k, b in enumerate(two) if taken.isdisjoint(b)]
    loose = [i for k in set(range(len(two))) - set(kept) for i in two[k] if i not in taken]
    kept.sort(key=lambda k: -sums_two[k])
    opened = {len(kept) - 1 - k for k in range(max(1, len(kept) // 20))} | set(rng.integers(0, max(1, len(kept)), 2).tolist())
    for n, k in enumerate(kept):
        if n in opened:
            loose.extend(two[k])
        else:
            child.append(list(two[k]))
            sums.append(sums_two[k])
    loose = _replaced(sizes, capacity, child, sums, sorted(loose))
    _fitted(sizes, capacity, sorted(loose, key=lambda i: -sizes[i]), child, sums)
    return child, sums


def crossed(sizes: list[int], capacity: int, one: list[list[int]], two: list[list[int]], rng: np.random.Generator) -> list[list[int]]:
    """Well-filled bins of ``one`` injected into ``two``; what they displace is fitted anew."""
    total = lambda bins: [sum(sizes[i] for i in b) for b in bins]
    return _crossed(sizes, capacity, one, total(one), two, total(two), rng)[0]


def evolved(sizes: list[int], capacity: int, population: list[list[list[int]]], seed: int, generations: int, most: int = 6, patience: int | None = None) -> list[list[list[int]]]:
    """The population after some generations, best first, of ``most`` solutions.

    Ends early where no bin can be saved or nothing was gained for
    ``patience`` generations.
    """
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    rated = lambda mark, bins, sums: (len(bins), -_fitness(capacity, sums), mark, bins, sums)
    scored = sorted((rated(k, s, [sum(sizes[i] for i in b) for b in s]) for k, s in enumerate(population)), key=lambda t: t[:3])
    mark, idle = len(scored), 0
    for _ in range(generations):
        if not scored or scored[0][0] <= least or len(scored) < 2 or (patience is not None and idle >= patience):
            break
        # Two different parents; the bins of the better one of two drawn are injected.
        a, b, c = rng.permutation(len(scored))[:3] if len(scored) > 2 else (0, 1, 1)
        one = min(a, c)
        two = b if b != one else max(a, c)
        mark += 1
        entry = rated(mark, *_crossed(sizes, capacity, *scored[one][3:], *scored[two][3:], rng))
        idle = 0 if entry[:2] < scored[0][:2] else idle + 1
        # A child that equals a solution in count and fill would crowd it out.
        if all(entry[:2] != s[:2] for s in scored):
            scored = sorted([*scored, entry], key=lambda t: t[:3])[:most]
    return [t[3] for t in scored]


def _beginnings(sizes: list[int], capacity: int, seed: int, most: int = 6) -> list[list[list[int]]]:
    """Best-fit solutions: the first of falling sizes, the others of sizes falling but for some noise."""
    rng = np.random.default_rng(seed)
    size = np.array(sizes, float)
    first = best_fit(sizes, capacity, np.argsort(-size, kind="stable").tolist())
    if len(first) <= -(-sum(sizes) // capacity):
        return [first]
    noise = np.linspace(0.05, 0.5, most - 1)
    return [first, *[best_fit(sizes, capacity, np.argsort(-size * rng.uniform(1 - n, 1 + n, len(size)), kind="stable").tolist()) for n in noise]]


def _coded(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _decoded(code: np.ndarray) -> list[list[int]]:
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    return [part.tolist() for part in np.split(order, cuts)] if len(code) else []


_ISLAND = "spec_id bigint, capacity bigint, block bigint, island int, last boolean, ids array<string>, sizes array<bigint>, elite array<int>, bins int, least int"


def _epoch():
    """Evolve one island per row, from its own elite and the migrant if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spec, capacity, block, island, last = (batch.column(c).to_pylist() for c in ("spec_id", "capacity", "block", "island", "last"))
            sizes, elites = batch.column("sizes").to_pylist(), batch.column("elites").to_pylist()
            codes, counts, least = [], [], []
            for k in range(batch.num_rows):
                budget, guests = LAST if last[k] else PASSING, [e for e in elites[k] or [] if e]
                seed = (spec[k] * 1_000_003 + block[k] * 101 + island[k] * 7 + len(guests)) % (1 << 31)
                begin = [_decoded(np.array(e)) for e in guests] + _beginnings(sizes[k], capacity[k], seed, budget["population"] - len(guests))[1 if guests else 0 :]
                best = evolved(sizes[k], capacity[k], begin, seed, budget["generations"], budget["population"], budget["patience"])[0]
                codes.append(_coded(best, len(sizes[k])))
                counts.append(len(best))
                least.append(-(-sum(sizes[k]) // capacity[k]))
            names = ["spec_id", "capacity", "block", "island", "last", "ids", "sizes"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(codes, pa.list_(pa.int32())), pa.array(counts, pa.int32()), pa.array(least, pa.int32())], names=[*names, "elite", "bins", "least"])

    return run


def _round(items: DataFrame, number: int) -> DataFrame:
    """(spec_id, capacity, block, item, size, bin) of the best solution of every block."""
    key = ["spec_id", "block"]
    dealt = items.groupBy("spec_id", "capacity", "block", "last").agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("members"))
    islands = F.when(F.col("last"), LAST["islands"]).otherwise(PASSING["islands"])
    state = dealt.select("spec_id", "capacity", "block", F.explode(F.sequence(F.lit(0), islands - 1)).alias("island"), "last", F.col("members.item").alias("ids"), F.col("members.size").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("elites"))
    epochs = []
    for epoch in range(EPOCHS):
        grown = durable(state.repartition(*key, "island").mapInArrow(_epoch(), _ISLAND))
        epochs.append(grown)
        if epoch + 1 < EPOCHS:
            # Only blocks above the lower bound go on; the elite migrates to the next island of its block.
            open_ = grown.groupBy(*key).agg(F.min("bins").alias("_b"), F.max("least").alias("_l")).where("_b > _l").select(*key)
            going = grown.join(open_, key, "left_semi")
            moved = going.select(*key, F.pmod(F.col("island") + 1, islands).cast("int").alias("island"), F.col("elite").alias("migrant"))
            state = going.join(moved, [*key, "island"], "left").withColumn("elites", F.array_compact(F.array("elite", "migrant"))).drop("elite", "migrant", "bins", "least")
    all_ = epochs[0]
    for grown in epochs[1:]:
        all_ = all_.unionByName(grown)
    best = all_.groupBy(*key).agg(F.min_by(F.struct("capacity", "ids", "sizes", "elite"), F.struct("bins", "island")).alias("s"))
    placed = best.select("spec_id", F.col("s.capacity").alias("capacity"), "block", F.explode(F.arrays_zip(F.col("s.ids").alias("item"), F.col("s.sizes").alias("size"), F.col("s.elite").alias("bin"))).alias("m"))
    return placed.select("spec_id", "capacity", "block", "m.item", "m.size", F.concat_ws("-", F.lit(f"r{number}"), F.col("block").cast("string"), F.col("m.bin").cast("string")).alias("bin"))


def _by_spec(values: dict[int, int | float]):
    """A column that tells the value of each row's specification; null without one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("spec_id")) if values else F.lit(None)


def packed(items: DataFrame, containers: DataFrame, block: int = BLOCK) -> DataFrame:
    """(spec_id, item, part, size, container): every item in one container of each capacity.

    ``items``: item (text), size (whole number).  ``containers``: spec_id,
    capacity; each is held by the driver and takes a whole copy of the items.
    An item larger than the capacity comes in parts, each full but the last.
    Items of size 0 or null take no space and are given the container
    ``empty``; specs without a positive capacity are left out; repeated items
    are packed as often as they come, told apart by their part.
    """
    rows = containers.where("spec_id is not null and capacity > 0").select(F.col("spec_id").cast("bigint"), F.col("capacity").cast("bigint")).distinct().collect()
    specs = F.array(*[F.struct(F.lit(a).cast("bigint").alias("spec_id"), F.lit(b).cast("bigint").alias("capacity")) for a, b in sorted(map(tuple, rows))]) if rows else F.array().cast("array<struct<spec_id:bigint,capacity:bigint>>")
    sized = items.select("item", F.coalesce(F.col("size").cast("bigint"), F.lit(0).cast("bigint")).alias("size"), F.monotonically_increasing_id().alias("_row"))
    sized = durable(sized)
    every = sized.withColumn("_spec", F.explode(specs)).select("*", "_spec.spec_id", "_spec.capacity").drop("_spec")
    full = F.floor(F.col("size") / F.col("capacity"))
    parts = every.withColumn("_full", full).withColumn("rest", F.col("size") - full * F.col("capacity"))
    whole = parts.where("_full > 0").select("spec_id", "item", "_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_full"))).alias("part"), F.col("capacity").alias("size"))
    whole = whole.select("spec_id", "item", "_row", "part", "size", F.concat_ws("-", F.lit("full"), F.col("_row").cast("string"), F.col("part").cast("string")).alias("container"))
    empty = parts.where("size = 0").select("spec_id", "item", "_row", F.lit(1).cast("bigint").alias("part"), "size", F.lit("empty").alias("container"))
    left = parts.where("rest > 0").select("spec_id", "capacity", F.concat_ws(":", F.col("_row").cast("string"), (F.col("_full") + 1).cast("string")).alias("item"), F.col("rest").alias("size"))
    done, number, whole_search = None, 0, set()
    counts = _counted(left)
    while counts:
        blocks = {s: -(-n // block) for s, n in counts.items()}
        dealt = left.withColumn("_k", _by_spec(blocks)).withColumn("block", F.pmod(F.xxhash64("item", F.lit(number)), F.col("_k"))).withColumn("last", (F.col("_k") == 1) | F.col("spec_id").isin(sorted(whole_search))).drop("_k")
        solved = durable(_round(dealt, number))
        joined = solved.join(solved.groupBy("spec_id", "bin").agg(F.sum("size").alias("filled"), F.count(F.lit(1)).alias("held")), ["spec_id", "bin"])
        poor = (_by_spec(blocks) > 1) & (F.col("filled") < F.col("capacity") * FULL)
        stays = _counted(joined.where(poor))
        # Where little settles, all that stays has the whole search; after that the emptiest bins go on: about as many items as one block holds.
        little = {s for s, n in stays.items() if n > LITTLE * counts[s]}
        slow = {s: block / counts[s] for s in little & whole_search}
        whole_search |= little
        if slow:
            share = F.col("filled") / F.col("capacity")
            levels = joined.where(poor).where(_by_spec(slow).isNotNull()).groupBy("spec_id").agg(F.percentile_approx(share, F.array(*[F.lit(k / 1000) for k in range(1001)]), 10_000).alias("q")).collect()
            limit = {r["spec_id"]: float(r["q"][min(1000, int(1000 * slow[r["spec_id"]]))]) for r in levels}
            poor = poor & F.coalesce(share < _by_spec(limit), F.lit(True))
        settled = joined.where(~poor).select("spec_id", "item", "size", F.col("bin").alias("container"))
        done = settled if done is None else done.unionByName(settled)
        left = durable(joined.where(poor).select("spec_id", "capacity", "item", "size"))
        counts, number = _counted(left), number + 1
    named = rest_of(done, sized)
    return whole.unionByName(empty).unionByName(named).select("spec_id", "item", "part", "size", "container")


def _counted(rows: DataFrame) -> dict[int, int]:
    return {r["spec_id"]: r["n"] for r in rows.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n")).collect()}


def rest_of(done: DataFrame | None, sized: DataFrame) -> DataFrame:
    """The packed rests under the names of their items."""
    if done is None:
        return sized.where(F.lit(False)).select(F.lit(0).cast("bigint").alias("spec_id"), "item", "_row", F.lit(0).cast("bigint").alias("part"), "size", F.lit("").alias("container"))
    named = done.select("spec_id", F.split_part("item", F.lit(":"), F.lit(1)).cast("bigint").alias("_row"), F.split_part("item", F.lit(":"), F.lit(2)).cast("bigint").alias("part"), "size", "container")
    return named.join(sized.select("_row", "item"), "_row").select("spec_id", "item", "_row", "part", "size", "container")
