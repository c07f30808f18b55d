"""Points near other points and the regions that contain them.

Method: the plane is range-partitioned by latitude (northing) into strips of
equal weight with an overlap of the search distance; large inputs also get
range-partitioned segments inside the strips.  Each cell is sorted by easting
and swept once: points that are still within the distance of the sweep line,
and regions whose extent it crosses, form the active set.  Distances are
verified, and every pair has one owner cell, so no pair appears twice and
nothing needs a distinct afterwards.

Memory of a task is bounded by the active set, not by the cell: the sweep
runs over Arrow batches and carries only the active tail from one to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a cell should hold, and the most edges taken from the sketch for each axis.
ROWS_PER_CELL = 16384
MOST_STRIPS = 1024
PAIRS_AT_ONCE = 1 << 20

_SCHEMA = "id_a bigint, id_b bigint, relation string, distance double"


def _edges(points: DataFrame, distance: float, rows_per_cell: int) -> tuple[list[float], list[float]]:
    """Strip and segment boundaries from one mergeable quantile sketch of the points."""
    quantiles = [i / MOST_STRIPS for i in range(1, MOST_STRIPS)]
    row = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("y", quantiles, 10 * MOST_STRIPS).alias("y"),
        F.percentile_approx("x", quantiles, 10 * MOST_STRIPS).alias("x"),
    ).first()
    cells = max(1, -(-row["n"] // rows_per_cell))
    strips = min(cells, MOST_STRIPS)
    segments = min(-(-cells // strips), MOST_STRIPS)

    def pick(values: list[float] | None, k: int) -> list[float]:
        inner = sorted({values[round(i * MOST_STRIPS / k) - 1] for i in range(1, k)}) if values and k > 1 else []
        return [-float("inf"), *inner, float("inf")] if inner else [-float("inf"), 0.0, float("inf")]

    return pick(row["y"], strips), pick(row["x"], segments)


def _bucket(df: DataFrame, edges: list[float], columns: dict[str, str]) -> DataFrame:
    for source, target in columns.items():
        df = Bucketizer(splits=edges, inputCol=source, outputCol=target, handleInvalid="keep").transform(df)
        df = df.withColumn(target, F.col(target).cast("int"))
    return df


def _cells(df: DataFrame, y_edges: list[float], x_edges: list[float]) -> DataFrame:
    """Copies of each row for every cell its extent (y_lo..y, x_lo..x_hi) touches."""
    df = _bucket(df, y_edges, {"y_lo": "_s0", "y_hi": "_s1"})
    df = _bucket(df, x_edges, {"x_lo": "_g0", "x_hi": "_g1"})
    return df.withColumn("strip", F.explode(F.sequence("_s0", "_s1"))).withColumn("segment", F.explode(F.sequence("_g0", "_g1")))


def _contains(edges: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Even-odd rule over all edges of a region, holes included."""
    inside = np.zeros(len(px), bool)
    step = max(1, PAIRS_AT_ONCE // max(1, len(edges)))
    x1, y1, x2, y2 = edges.T
    rise = np.where(y2 == y1, 1.0, y2 - y1)
    for k in range(0, len(px), step):
        x, y = px[k : k + step, None], py[k : k + step, None]
        crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / rise + x1)
        inside[k : k + step] = crosses.sum(1) % 2 == 1
    return inside


class _Sweep:
    """The active set of one task; ``feed`` takes sorted columns and yields pairs."""

    def __init__(self, distance: float):
        self.distance = distance
        self.cell = None
        self.tail = {k: np.empty(0, t) for k, t in (("x", float), ("y", float), ("id", np.int64), ("hy", bool), ("hx", bool))}
        self.regions: list[tuple[int, float, float, np.ndarray]] = []

    def feed(self, cells: np.ndarray, col: dict[str, np.ndarray], edges: list) -> Iterator[tuple]:
        cuts = np.flatnonzero(np.diff(cells)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(cells)]):
            if lo == hi:
                continue
            if cells[lo] != self.cell:
                self.cell, self.regions = cells[lo], []
                self.tail = {k: v[:0] for k, v in self.tail.items()}
            yield from self._advance({k: v[lo:hi] for k, v in col.items()}, edges[lo:hi])

    def _advance(self, col: dict[str, np.ndarray], edges: list) -> Iterator[tuple]:
        point = col["kind"] == 1
        for i in np.flatnonzero(~point):
            ring = np.asarray(edges[i], float).reshape(-1, 4)
            if len(ring):
                self.regions.append((int(col["id"][i]), float(col["x"][i]), float(col["x_hi"][i]), ring))
        new = {k: col[k][point] for k in self.tail}
        front = col["x"][-1]
        yield from self._within(new)
        self.regions = [r for r in self.regions if r[2] >= front]
        yield from self._near(new)
        held = {k: np.concatenate([self.tail[k], new[k]]) for k in self.tail}
        keep = held["x"] >= front - self.distance
        self.tail = {k: v[keep] for k, v in held.items()}

    def _within(self, new: dict[str, np.ndarray]) -> Iterator[tuple]:
        home = new["hy"] & new["hx"]
        x, y, ids = (new[k][home] for k in ("x", "y", "id"))
        for region, left, right, ring in self.regions:
            a, b = np.searchsorted(x, left, "left"), np.searchsorted(x, right, "right")
            if a == b:
                continue
            bottom, top = min(ring[:, 1].min(), ring[:, 3].min()), max(ring[:, 1].max(), ring[:, 3].max())
            k = a + np.flatnonzero((y[a:b] >= bottom) & (y[a:b] <= top))
            k = k[_contains(ring, x[k], y[k])]
            yield ids[k], np.full(len(k), region), "within", np.zeros(len(k))

    def _near(self, new: dict[str, np.ndarray]) -> Iterator[tuple]:
        held = {k: np.concatenate([self.tail[k], new[k]]) for k in self.tail}
        first = np.searchsorted(held["x"], new["x"] - self.distance, "left")
        own = np.arange(len(self.tail["x"]), len(held["x"]))
        counts = own - first
        ends = np.cumsum(counts)
        k = 0
        while k < len(own):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS_AT_ONCE, "right")))
            n = counts[k:stop]
            right = np.repeat(own[k:stop], n)
            left = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k:stop], n)
            dy, dx = held["y"][right] - held["y"][left], held["x"][right] - held["x"][left]
            ok = np.abs(dy) <= self.distance
            ok &= (held["hy"][left] | held["hy"][right]) & (held["hx"][left] | held["hx"][right])
            left, right, far = left[ok], right[ok], np.hypot(dx[ok], dy[ok])
            ok = (far <= self.distance) & (held["id"][left] != held["id"][right])
            yield held["id"][left[ok]], held["id"][right[ok]], "near", far[ok]
            k = stop


def _swept(distance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep(distance)
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "id", "x", "y", "x_hi")}
            cells = batch.column("strip").to_numpy() * np.int64(MOST_STRIPS + 2) + batch.column("segment").to_numpy()
            col["hy"], col["hx"] = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("home_y", "home_x"))
            edges = batch.column("edges")
            flat, start = edges.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(edges).to_numpy(zero_copy_only=False)).astype(np.int64))])
            parts = [flat[start[i] : start[i + 1]] for i in range(batch.num_rows)] if len(flat) else [flat] * batch.num_rows
            for a, b, relation, far in sweep.feed(cells, col, parts):
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([relation]).take(pa.array(np.zeros(len(a), np.int32))), pa.array(far)],
                        names=["id_a", "id_b", "relation", "distance"],
                    )

    return run


def near_and_within(points: DataFrame, regions: DataFrame | None, distance: float, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Pairs of points at most ``distance`` apart and pairs of a point and a region around it.

    ``points``: id BIGINT, x DOUBLE, y DOUBLE.  ``regions``: id BIGINT, geom
    GEOM (outer ring first, holes after).  Result: id_a < id_b, relation
    (``near`` or ``within``), distance (0 for ``within``).

    Rows with a null id or coordinate, and regions without a ring, take no
    part; empty inputs give no rows; points of equal coordinates are near each
    other at distance 0; a repeated id is never paired with itself.  Columns
    beyond those named are ignored.
    """
    usable = points.select("id", F.col("x").cast("double"), F.col("y").cast("double")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    )
    y_edges, x_edges = _edges(usable, distance, rows_per_cell)
    cells = _cells(
        usable.select("*", (F.col("y") - distance).alias("y_lo"), F.col("y").alias("y_hi"), (F.col("x") - distance).alias("x_lo"), F.col("x").alias("x_hi")), y_edges, x_edges
    ).select(
        "strip", "segment", "x", F.lit(1).alias("kind"), "id", "y", "x_hi", (F.col("strip") == F.col("_s1")).alias("home_y"), (F.col("segment") == F.col("_g1")).alias("home_x"), F.lit(None).cast("array<double>").alias("edges")
    )
    if regions is not None:
        ring_edges = lambda r: F.zip_with(
            F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
        )
        shapes = regions.where(F.col("id").isNotNull()).select("id", F.flatten(F.transform(F.filter(F.col("geom")["rings"], lambda r: F.size(r) > 3), ring_edges)).alias("sides"))
        least, most = (lambda a, b: F.array_min(F.transform("sides", lambda e: F.least(e[a], e[b])))), (lambda a, b: F.array_max(F.transform("sides", lambda e: F.greatest(e[a], e[b]))))
        shapes = shapes.where(F.size("sides") > 0).select("id", "sides", least("y1", "y2").alias("y_lo"), most("y1", "y2").alias("y_hi"), least("x1", "x2").alias("x_lo"), most("x1", "x2").alias("x_hi"))
        bounds = F.array(*[F.lit(v) for v in y_edges])
        low, high = F.get(bounds, F.col("strip")), F.get(bounds, F.col("strip") + 1)
        crossing = F.filter("sides", lambda e: (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high))
        flat = F.flatten(F.transform(crossing, lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"])))
        cells = cells.unionByName(
            _cells(shapes, y_edges, x_edges).select(
                "strip", "segment", F.col("x_lo").alias("x"), F.lit(0).alias("kind"), "id", F.col("y_lo").alias("y"), "x_hi", F.lit(False).alias("home_y"), F.lit(False).alias("home_x"), flat.alias("edges")
            )
        )
    swept = cells.repartition("strip", "segment").sortWithinPartitions("strip", "segment", "x", "kind")
    return swept.mapInArrow(_swept(distance), _SCHEMA)
