"""Entities matched across sources without common keys.

Method: candidate pairs come from blocking by place and by identifier; each
has a vector of similarities.  For every pair of sources two regularised
Gaussians, for matches and for all else, are fitted without labels by
expectation-maximisation.  Every expectation is corrected for transitivity
before the parameters follow from it, until these change no more: if A matches
B and B matches C, the posterior of A and C may not be smaller than the
product; the less sure of two links that imply a contradicted pair is lowered,
a candidate A-C is raised, and a link that no blocking key found is inferred
where the records agree in size.
The result is a posterior for every pair; links are one to one between two
sources.

All candidates enter the fit: their sums come from the counts of a lattice of
similarity vectors (bounded by its cells, whatever the number of pairs), to
which the pairs that transitivity changed add what they changed by.  The
parameters are a table with a row for each pair of sources; fits run in the
executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.functions import values as V
from terraweave.functions.crs import add_utm
from terraweave.functions.ground import ZONE, first_rows, on_ground
from terraweave.session import durable, durable_counted

#: Cells of the lattice along each similarity, and rounds of the first fit, which knows no transitivity.
LATTICE = 24
ROUNDS = 40
#: The most rounds with transitivity, and the change of weights and means below which they end.
MOST_ROUNDS = 5
STILL = 0.003
#: Parameters of up to this many pairs of sources are broadcast (some 300 bytes each).
MOST_BROADCAST = 10_000
#: A position that more records of one source share to the centimetre may be a placeholder: such records are candidates by this
#: place and by number, and tell nothing of how sources lie displaced.
SAME_PLACE = 20
#: Parts in which the records of a shared place are joined with those around it.
SHARED_WAYS = 32
RIDGE = 0.15
SIMILARITIES = ("s1", "s2", "s3")
#: Pairs of less posterior cannot break transitivity.
ACTIVE = 0.05


# --- records -----------------------------------------------------------------


def _ring_moments(ring: Column) -> Column:
    """STRUCT<area, cx, cy> of a closed ring, relative to its first vertex for accuracy."""
    first = F.get(ring, F.lit(0))
    x, y = (lambda p: p["x"] - first["x"]), (lambda p: p["y"] - first["y"])
    steps = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.struct((x(a) * y(b) - x(b) * y(a)).alias("w"), (x(a) + x(b)).alias("sx"), (y(a) + y(b)).alias("sy")),
    )
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(steps, zero, lambda s, t: F.struct((s["w"] + t["w"]).alias("w"), (s["mx"] + t["w"] * t["sx"]).alias("mx"), (s["my"] + t["w"] * t["sy"]).alias("my")))


def shape_columns(df: DataFrame, geom_metric: str, geom: str) -> DataFrame:
    """Add area (square metres), cx, cy of the outer ring; null without a usable polygon.

    ``geom_metric`` counts if its first vertex is a position of the grid, else
    ``geom`` once its axes are in order.
    """
    own = df.columns
    metric, degrees = F.get(F.col(geom_metric)["rings"], F.lit(0)), F.get(F.col(geom)["rings"], F.lit(0))
    m, g = F.get(metric, F.lit(0)), F.get(degrees, F.lit(0))
    is_metric = m["x"].between(4e5, 8e5) & m["y"].between(1.1e6, 1.5e6)
    straight, swapped = on_ground(g["x"], g["y"]), on_ground(g["y"], g["x"])
    ring = F.when(is_metric, metric).when(straight, degrees).when(swapped, F.transform(degrees, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y"))))
    df = df.select(*own, F.when(F.size(ring) > 3, ring).alias("_ring"), F.coalesce(is_metric, F.lit(False)).alias("_metric"))
    df = df.select(*own, "_metric", F.get("_ring", F.lit(0)).alias("_o"), F.when(F.col("_ring").isNotNull(), _ring_moments(F.col("_ring"))).alias("_m"))
    w = F.col("_m.w")
    some = w.isNotNull() & (w != 0)
    df = df.select(
        *own, "_metric", F.abs(w / 2).alias("_a"), F.when(some, F.col("_o.x") + F.col("_m.mx") / (3 * w)).alias("_x"), F.when(some, F.col("_o.y") + F.col("_m.my") / (3 * w)).alias("_y")
    )
    df = df.withColumn("_lon", F.when(~F.col("_metric"), F.col("_x"))).withColumn("_lat", F.when(~F.col("_metric"), F.col("_y")))
    df = add_utm(df, "_lon", "_lat", "_ux", "_uy", ZONE)
    # One degree in metres at the latitude of the shape, by the radii of curvature, and the scale of the grid.
    phi = F.radians("_lat")
    s2 = F.pow(F.sin(phi), 2)
    square = (111319.490793 * F.cos(phi) / F.sqrt(1 - 0.00669438 * s2)) * (111319.490793 * (1 - 0.00669438) / F.pow(1 - 0.00669438 * s2, 1.5)) * 0.9996**2
    return df.select(
        *own,
        F.when(F.col("_metric"), F.col("_a")).otherwise(F.col("_a") * square).alias("area"),
        F.coalesce("_ux", F.when(F.col("_metric"), F.col("_x"))).alias("cx"),
        F.coalesce("_uy", F.when(F.col("_metric"), F.col("_y"))).alias("cy"),
    )


def place_name(text: Column) -> Column:
    """Letters of a place name, in lower case, without words for village."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), r"\(v\)|\bvillage\b|\bvill\b\.?", ""), r"[^\p{L}\p{M}]+", ""), F.lit(""))


def _spellings(name: Column) -> Column:
    """A name and what is left of it without one letter; two names one edit apart share one of these."""
    holes = F.transform(F.sequence(F.lit(1), F.length(name)), lambda k: F.concat(F.substr(name, F.lit(1), k - 1), F.substr(name, k + 1)))
    return F.array_distinct(F.concat(F.array(name), holes))


def name_codes(rows: DataFrame) -> DataFrame:
    """(name, code) of every place name: the code most often given with it, else that of the closest such name.

    ``rows``: name and code, one row per record.  Names at most two edits
    apart are found by shared spellings, so no two names are compared without
    one; names that stay alone have no row.
    """
    counted = durable(rows.where("name is not null").groupBy("name", "code").agg(F.count(F.lit(1)).alias("n")))
    coded = counted.where("code is not null").groupBy("name").agg(F.max_by("code", F.struct("n", "code")).alias("code"), F.sum("n").alias("n"))
    names = counted.groupBy("name").agg(F.sum("n").alias("total"))
    sure = durable(names.join(coded, "name", "left"))
    known = sure.where("code is not null and n >= 3").select(F.col("name").alias("like"), "code", "n", F.explode(_spellings(F.col("name"))).alias("spelling"))
    alone = sure.where("code is null or n < 3").select("name", F.explode(_spellings(F.col("name"))).alias("spelling"))
    near = alone.join(known, "spelling").where(F.levenshtein("name", "like") <= 2)
    closest = near.groupBy("name").agg(F.min_by("code", F.struct(F.levenshtein("name", "like"), -F.col("n"), "code")).alias("close"))
    return sure.join(closest, "name", "left").select("name", F.coalesce(F.when(F.col("n") >= 3, F.col("code")), "close", "code").alias("code")).where("code is not null")


def _first_of(*keys: str) -> Column:
    stated = [F.nullif(F.trim(F.col("properties")[k]), F.lit("")) for k in keys]
    return F.coalesce(*stated)


def records(features: DataFrame, classes: list[str]) -> DataFrame:
    """One row per feature: id, dataset_id, source_feature_id, kind, shape, identifier and place code.

    A place that more than SAME_PLACE records of a source share is in sx and
    sy, not in x and y; where there is none these columns are left out.
    """
    own = ["id", "dataset_id", "source_feature_id", "run_id", "feature_class"]
    f = features.where(F.col("feature_class").isin(classes)).select(
        *own,
        "geom_metric",
        "geom",
        _first_of("survey_number", "Survey_Number", "survey_no").alias("number"),
        V.code_digits(_first_of("lgd_village_code", "village_code")).alias("code"),
        place_name(_first_of("village", "Village")).alias("name"),
        V.amount_token(F.lower(_first_of("extent"))).alias("stated"),
    )
    shaped = shape_columns(f, "geom_metric", "geom").drop("geom_metric", "geom")
    numbered = shaped.withColumn("_dense", V.dense_identifier(V.ascii_digits(V.squeezed(F.col("number"))))).select(
        *own, "code", "name", V.area_m2(F.col("stated")).alias("stated"), V.survey_number(F.col("_dense")).alias("number"), "area", "cx", "cy"
    )
    once = durable(first_rows(numbered, ["dataset_id", "source_feature_id"], "id", ["run_id", "feature_class", "code", "name", "stated", "number", "area", "cx", "cy"]))
    # A load may state its extents in another unit: a power of ten against the rest of the dataset.
    middle = lambda c: F.percentile_approx(c, 0.5, 1000)
    loads = once.where("stated > 0").groupBy("dataset_id", "run_id").agg(middle("stated").alias("_load"))
    whole = once.where("stated > 0").groupBy("dataset_id").agg(middle("stated").alias("_whole"))
    scale = loads.join(whole, "dataset_id").select("dataset_id", "run_id", F.pow(F.lit(10.0), F.round(F.log10(F.col("_load") / F.col("_whole")))).alias("_scale"))
    codes = name_codes(once.where(F.col("name").isNotNull()).select("name", "code")).withColumnRenamed("code", "_named")
    out = once.join(scale, ["dataset_id", "run_id"], "left").join(codes, "name", "left")
    size = F.coalesce(F.when(F.col("area") > 0, F.col("area")), F.when(F.col("stated") > 0, F.col("stated") / F.coalesce("_scale", F.lit(1.0))))
    placed = durable(
        out.select("id", F.col("dataset_id").alias("ds"), "source_feature_id", F.col("feature_class").alias("kind"), F.coalesce("code", "_named").alias("code"), "number", F.log(size).alias("size"), F.when(F.col("area") > 0, F.col("cx")).alias("x"), F.when(F.col("area") > 0, F.col("cy")).alias("y"))
    )
    spot = ["ds", "kind", F.round("x", 2).alias("_x"), F.round("y", 2).alias("_y")]
    crowded = placed.where("x is not null").groupBy(*spot).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SAME_PLACE)
    if crowded.isEmpty():
        return placed
    known = placed.select("*", *spot[2:]).join(crowded, ["ds", "kind", "_x", "_y"], "left")
    alone = [F.when(F.col("_n").isNull(), F.col(c)).alias(c) if c in ("x", "y") else c for c in placed.columns]
    return durable(known.select(*alone, *[F.when(F.col("_n").isNotNull(), F.col(c)).alias(f"s{c}") for c in ("x", "y")]))


# --- candidates --------------------------------------------------------------

#: Records farther apart (metres) are no candidates by place; sources lie displaced by less.
REACH = {"parcel": 30.0, "building": 20.0}
#: Records whose logarithms of size differ by more are no candidates: a plot over two parcels is larger by a third at least.
SIZE_LIMIT = {"parcel": 0.33, "building": 0.6}
SIZE_STEP = 0.6


def _two(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in ("id", "ds", "kind", "code", "number", "size", "x", "y")])


def _reach(kind: str) -> Column:
    return F.when(F.col(kind) == "parcel", REACH["parcel"]).otherwise(REACH["building"])


def _celled(rec: DataFrame, side: str, around: bool) -> DataFrame:
    """One side of a pair with its cell (k, u, v, w) of place and size, or with all cells within its reach."""
    reach = _reach("kind")
    cell, step = reach * 4, F.floor(F.col("size") / SIZE_STEP)
    if not around:
        spot = [F.col("kind").alias("k"), F.floor(F.col("x") / cell).alias("u"), F.floor(F.col("y") / cell).alias("v"), step.alias("w")]
        return _two(rec.select("*", *spot), ["k", "u", "v", "w"], side)
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / cell), F.floor((F.col(c) + reach) / cell))
    cells = rec.select("*", F.col("kind").alias("k"), F.explode(span("x")).alias("u"), span("y").alias("_v"), F.sequence(step - 1, step + 1).alias("_w"))
    return _two(cells.withColumn("v", F.explode("_v")).withColumn("w", F.explode("_w")), ["k", "u", "v", "w"], side)


def _within(pairs: DataFrame) -> DataFrame:
    """The pairs in order of their datasets, of similar size and within reach, with dx and dy."""
    dx, dy = F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")
    near = pairs.where((F.col("ds_a") < F.col("ds_b")) & (F.abs(F.col("size_a") - F.col("size_b")) <= F.when(F.col("kind_a") == "parcel", SIZE_LIMIT["parcel"]).otherwise(SIZE_LIMIT["building"]))).withColumn("dx", dx).withColumn("dy", dy)
    return near.where(F.hypot("dx", "dy") <= _reach("kind_a")).drop("k", "u", "v", "w", "kind_b")


def place_candidates(rec: DataFrame) -> DataFrame:
    """Pairs of one kind from two sources within reach of each other and of similar size; ``shared`` if an end has a shared place."""
    cell = ["k", "u", "v", "w"]
    placed = rec.where("x is not null and y is not null and size is not null")
    near = _within(_celled(placed, "a", True).join(_celled(placed, "b", False), cell)).withColumn("shared", F.lit(False))
    if "sx" not in rec.columns:
        return near
    crowd = rec.where("sx is not null and sy is not null and size is not null").withColumn("x", F.col("sx")).withColumn("y", F.col("sy"))
    # The cells of a shared place are hot: its records are dealt to parts, and what lies around goes to every part.
    part = F.explode(F.sequence(F.lit(0), F.lit(SHARED_WAYS - 1)))
    dealt = _celled(crowd, "a", True).withColumn("_part", F.pmod(F.xxhash64("id_a"), F.lit(SHARED_WAYS)).cast("int"))
    hot = durable(dealt.select(*cell).distinct())
    to_all = lambda df: _celled(df, "b", False).join(hot, cell, "left_semi").withColumn("_part", part)
    among = _within(dealt.join(to_all(crowd), [*cell, "_part"]).drop("_part"))
    around = dealt.join(to_all(placed), [*cell, "_part"]).drop("_part")
    turned = around.select(*cell, *[F.col(c).alias(c[:-1] + ("b" if c.endswith("_a") else "a")) for c in around.columns if c not in cell])
    return near.unionByName(among.unionByName(_within(around)).unionByName(_within(turned)).withColumn("shared", F.lit(True)))


def number_candidates(rec: DataFrame) -> DataFrame:
    """Pairs of parcels of one village and main number, of which one has no place.

    Records of one source that state the same number and neither place nor
    size cannot be told apart; as ties go to the smaller id, only the smallest
    of them can be linked, so it stands for all, and against records without
    size the same holds for those that have one.
    """
    main = F.substring_index("number", "/", 1)
    stated = rec.where("kind = 'parcel' and number is not null and code is not null")
    same = ["ds", "kind", "code", "number"]
    smallest = lambda df: df.groupBy(*same).agg(F.min_by(F.struct("id", "size", "x", "y"), "id").alias("_r")).select("_r.*", *same)
    sizeless, sized = smallest(stated.where("size is null")).select(*rec_columns(stated)), stated.where("size is not null").select(*rec_columns(stated))
    keyed = lambda df: df.select("*", F.col("code").alias("k"), main.alias("m"))
    known = keyed(sized.unionByName(sizeless))
    own = F.coalesce(F.floor(F.col("size") / SIZE_STEP).cast("bigint"), F.lit(-999).cast("bigint"))
    right = _two(known.select("*", own.alias("w")), ["k", "m", "w"], "b")
    steps = F.when(own == -999, F.array(own)).otherwise(F.array(own - 1, own, own + 1, F.lit(-999).cast("bigint")))
    left = _two(known.select("*", F.explode(steps).alias("w")), ["k", "m", "w"], "a")
    pairs = left.join(right, ["k", "m", "w"]).where("ds_a < ds_b and (x_a is null or x_b is null)").where(F.coalesce(F.abs(F.col("size_a") - F.col("size_b")) <= SIZE_LIMIT["parcel"], F.lit(True)))
    loose = _two(keyed(sizeless), ["k", "m"], "a").join(_two(keyed(smallest(sized)), ["k", "m"], "b"), ["k", "m"]).where("ds_a < ds_b")
    return pairs.drop("k", "m", "w").unionByName(loose.drop("k", "m")).drop("kind_b").withColumn("dx", F.lit(None).cast("double")).withColumn("dy", F.lit(None).cast("double"))


def rec_columns(rec: DataFrame) -> list[str]:
    return [c for c in ("id", "ds", "kind", "code", "number", "size", "x", "y") if c in rec.columns]


def _closeness(distance: Column, scale: float) -> Column:
    return F.exp(-distance / scale)


def similarity_vectors(rec: DataFrame) -> DataFrame:
    """(id_a, id_b, type, rank, s1, s2, s3) of every candidate; rank orders rivals, smaller first."""
    near, parts = durable(place_candidates(rec)), number_candidates(rec)
    if "sx" in rec.columns:
        # A pair of a shared place is found by number too: the number counts where it is the same, else the place.
        parts = durable(parts)
        near = durable(near.join(parts.where("number_a = number_b").select("id_a", "id_b"), ["id_a", "id_b"], "left_anti"))
        parts = parts.join(near.where("shared").select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")
    kept = ["id_a", "id_b", "ds_a", "ds_b", F.col("kind_a").alias("kind"), "size_a", "size_b"]
    size = F.abs(F.col("size_a") - F.col("size_b"))
    number = F.when(F.col("number_a").isNull() | F.col("number_b").isNull(), 0.5).when(F.col("number_a") == F.col("number_b"), 1.0).otherwise(0.0)
    # Parcels: sources lie displaced by a vector of the village, taken from pairs with the same number.
    parcels = near.where("kind_a = 'parcel'").withColumn("zone", F.coalesce("code_b", "code_a", F.lit("")))
    anchors = parcels.where("number_a = number_b and not shared").groupBy("ds_a", "ds_b", "zone").agg(F.percentile_approx("dx", 0.5, 1000).alias("zx"), F.percentile_approx("dy", 0.5, 1000).alias("zy"))
    moved = parcels.join(anchors, ["ds_a", "ds_b", "zone"], "left")
    rest = F.hypot(F.col("dx") - F.coalesce("zx", F.lit(0.0)), F.col("dy") - F.coalesce("zy", F.lit(0.0)))
    of_parcels = moved.select(*kept, rest.alias("rank"), _closeness(rest, 2.5).alias("s1"), _closeness(size, 0.15).alias("s2"), number.alias("s3"))
    # Buildings: blocks of a source lie displaced; a pair agrees if its neighbours' best pairs lie displaced alike.
    houses = near.where("kind_a = 'building'").withColumn("far", F.hypot("dx", "dy") + 5 * size)
    best = lambda c: F.row_number().over(Window.partitionBy("ds_a", "ds_b", c).orderBy("far", "id_a", "id_b"))
    mutual = houses.where("not shared").withColumn("_ra", best("id_a")).withColumn("_rb", best("id_b")).where("_ra = 1 and _rb = 1").where(size < 0.4)
    block = 50.0
    at = lambda c: F.floor(F.col(c) / block)
    posts = mutual.select(F.col("ds_a").alias("ds_p"), F.col("ds_b").alias("ds_q"), F.col("id_a").alias("id_p"), F.col("x_a").alias("x_p"), F.col("y_a").alias("y_p"), F.col("dx").alias("dx_p"), F.col("dy").alias("dy_p"))
    posts = posts.select("*", F.explode(F.sequence(at("x_p") - 1, at("x_p") + 1)).alias("u"), F.sequence(at("y_p") - 1, at("y_p") + 1).alias("_v")).withColumn("v", F.explode("_v")).drop("_v")
    asked = houses.select("id_a", "id_b", F.col("ds_a").alias("ds_p"), F.col("ds_b").alias("ds_q"), "dx", "dy", "x_a", "y_a", at("x_a").alias("u"), at("y_a").alias("v"))
    told = asked.join(posts, ["ds_p", "ds_q", "u", "v"]).where((F.col("id_a") != F.col("id_p")) & (F.hypot(F.col("x_a") - F.col("x_p"), F.col("y_a") - F.col("y_p")) <= 60))
    off = F.hypot(F.col("dx") - F.col("dx_p"), F.col("dy") - F.col("dy_p"))
    told = told.groupBy("id_a", "id_b").agg(F.min(off).alias("o1"), F.sum(F.exp(-off * off / 8)).alias("votes"), F.count(F.lit(1)).alias("n"))
    judged = houses.join(told, ["id_a", "id_b"], "left")
    share = F.col("votes") / F.col("n")
    agree = F.when(F.col("n") >= 2, F.least(share * 2, F.lit(1.0))).when(F.col("n") == 1, _closeness(F.col("o1"), 3.0)).otherwise(_closeness(F.hypot("dx", "dy"), 5.0))
    of_houses = judged.select(*kept, (F.col("far") / 4 - 4 * agree).alias("rank"), agree.alias("s1"), _closeness(size, 0.4).alias("s2"), _closeness(F.hypot("dx", "dy"), 8.0).alias("s3"))
    # The roll: number and extent.
    same = F.when(F.col("number_a") == F.col("number_b"), 1.0).otherwise(0.2)
    of_roll = parts.select(*kept, (size.isNull().cast("double") + F.coalesce(size, F.lit(0.0)) - 10 * same).alias("rank"), same.alias("s1"), F.coalesce(_closeness(size, 0.15), F.lit(0.6)).alias("s2"), same.alias("s3"))
    both = of_parcels.unionByName(of_houses).unionByName(of_roll)
    return both.select("id_a", "id_b", "ds_a", "ds_b", "kind", F.concat_ws("|", "ds_a", "ds_b").alias("type"), "size_a", "size_b", "rank", *SIMILARITIES)


# --- mixture -----------------------------------------------------------------


class Mixture:
    """Two regularised Gaussians over similarity vectors: index 0 all else, 1 matches."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray):
        self.weight, self.mean, self.cov = weight, mean, cov

    @classmethod
    def fitted(cls, x: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> Mixture:
        """EM over weighted vectors, begun where the mean similarity is high."""
        score = x.mean(1)
        level = (np.average(score, weights=n) + score.max()) / 2
        gamma = 1 / (1 + np.exp(-12 * (score - level)))
        mixture = None
        for _ in range(rounds):
            mixture = cls.from_sums(*weighted_sums(x, n, gamma))
            gamma = mixture.posterior(x)
        return mixture

    @classmethod
    def from_sums(cls, mass: np.ndarray, first: np.ndarray, second: np.ndarray) -> Mixture:
        """Parameters from the responsibilities' mass and first and second moments."""
        mass = np.maximum(mass, 1e-6)
        mean = first / mass[:, None]
        cov = second / mass[:, None, None] - mean[:, :, None] * mean[:, None, :]
        # The ridge grows with the gap between the means: features that tell little are tied down most.
        ridge = np.diag(RIDGE * (mean[1] - mean[0]) ** 2 + 1e-3)
        return cls(np.clip(mass / mass.sum(), 1e-4, 1 - 1e-4), mean, cov + ridge)

    def _log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        d = x - self.mean[k]
        return np.log(self.weight[k]) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(self.cov[k]), d) + np.linalg.slogdet(self.cov[k])[1])

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self._log_density(x, 0) - self._log_density(x, 1), -60, 60)))

    def row(self, name: str) -> tuple:
        """The parameters as a row of _PARAMETERS: what is needed to go on fitting, and constants and inverses for the density."""
        inverse = np.linalg.inv(self.cov)
        level = np.log(self.weight) - 0.5 * np.linalg.slogdet(self.cov)[1]
        return name, self.weight.tolist(), self.mean.ravel().tolist(), self.cov.ravel().tolist(), level.tolist(), inverse.ravel().tolist()

    @classmethod
    def of(cls, weight, mean, cov) -> Mixture:
        k = len(SIMILARITIES)
        return cls(np.array(weight, float), np.array(mean, float).reshape(2, k), np.array(cov, float).reshape(2, k, k))


def weighted_sums(x: np.ndarray, n: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [n * (1 - gamma), n * gamma]
    return np.array([w.sum() for w in parts]), np.array([w @ x for w in parts]), np.array([(x * w[:, None]).T @ x for w in parts])


_PARAMETERS = "type string, weight array<double>, mean array<double>, cov array<double>, level array<double>, inverse array<double>"


def lattice_counts(vectors: DataFrame) -> DataFrame:
    """(type, cell, n) of the occupied lattice cells; at most LATTICE cubed cells a type."""
    cell = [F.least(F.floor(F.col(c) * LATTICE), F.lit(LATTICE - 1)).cast("int").alias(c) for c in SIMILARITIES]
    return vectors.select("type", *cell).groupBy("type", *SIMILARITIES).agg(F.count(F.lit(1)).alias("n"))


def _cells(lattice: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ordered = lattice.sort_values(list(SIMILARITIES))
    return (ordered[list(SIMILARITIES)].to_numpy(float) + 0.5) / LATTICE, ordered["n"].to_numpy(float)


def first_fit(lattice: DataFrame) -> DataFrame:
    """Parameters of every type from the lattice alone; a type's cells are bounded, so each fits in one task."""

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([Mixture.fitted(*_cells(cells)).row(cells["type"].iloc[0])], columns=_PARAMETER_NAMES)

    return lattice.groupBy("type").applyInPandas(fit, _PARAMETERS)


_PARAMETER_NAMES = [c.split()[0] for c in _PARAMETERS.split(", ")]


def next_fit(lattice: DataFrame, parameters: DataFrame, fixed: DataFrame) -> DataFrame:
    """Parameters that follow from the posteriors of all pairs, ``fixed`` being those that transitivity changed."""
    delta = F.col("p") - F.col("before")
    moments = [F.sum(delta), *[F.sum(delta * F.col(a)) for a in SIMILARITIES], *[F.sum(delta * F.col(a) * F.col(b)) for a in SIMILARITIES for b in SIMILARITIES]]
    moved = fixed.where("before is not null").groupBy("type").agg(F.array(*moments).alias("moved"))
    current = parameters.join(moved, "type", "left")
    size = len(SIMILARITIES)

    def fit(cells: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or own.empty:
            return pd.DataFrame([], columns=_PARAMETER_NAMES)
        row = own.iloc[0]
        x, n = _cells(cells)
        mass, first, second = weighted_sums(x, n, Mixture.of(row["weight"], row["mean"], row["cov"]).posterior(x))
        if row["moved"] is not None:
            change = np.array(row["moved"], float)
            sign = np.array([-1.0, 1.0])
            mass = mass + sign * change[0]
            first = first + sign[:, None] * change[1 : 1 + size]
            second = second + sign[:, None, None] * change[1 + size :].reshape(size, size)
        return pd.DataFrame([Mixture.from_sums(mass, first, second).row(row["type"])], columns=_PARAMETER_NAMES)

    return lattice.groupBy("type").cogroup(current.groupBy("type")).applyInPandas(fit, _PARAMETERS)


def with_posterior(vectors: DataFrame, parameters: DataFrame, types: int) -> DataFrame:
    """``vectors`` with the posterior p of their type's mixture."""
    own = parameters.select("type", "mean", "level", "inverse")
    joined = vectors.join(F.broadcast(own) if types <= MOST_BROADCAST else own.hint("merge"), "type")
    size, logs = len(SIMILARITIES), []
    for k in (0, 1):
        d = [F.col(c) - F.get("mean", F.lit(k * size + i)) for i, c in enumerate(SIMILARITIES)]
        square = sum((d[i] * d[j] * F.get("inverse", F.lit((k * size + i) * size + j)) for i in range(size) for j in range(size)), F.lit(0.0))
        logs.append(F.get("level", F.lit(k)) - square * 0.5)
    p = 1 / (1 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logs[0] - logs[1]))))
    return joined.select(*vectors.columns, p.alias("p"))


def _mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are the best of both ends between their sources."""
    rank = lambda c: F.row_number().over(Window.partitionBy("type", c).orderBy(F.desc("p"), "rank", "id_a", "id_b"))
    return pairs.withColumn("_ra", rank("id_a")).withColumn("_rb", rank("id_b")).where("_ra = 1 and _rb = 1").drop("_ra", "_rb")


def _wedges(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links seen from both ends, and (i, mid, j) of every two links that meet in a record."""
    turned = active.select(*[F.col(c + o).alias(c + s) for c in ("id", "ds", "size") for o, s in (("_b", "_a"), ("_a", "_b"))], "kind", "p")
    both = active.select(*turned.columns).unionByName(turned)
    one = both.select(F.col("id_b").alias("mid"), F.col("id_a").alias("i"), F.col("ds_a").alias("di"), F.col("size_a").alias("zi"), F.col("p").alias("pi"), "kind")
    two = both.select(F.col("id_b").alias("mid"), F.col("id_a").alias("j"), F.col("ds_a").alias("dj"), F.col("size_a").alias("zj"), F.col("p").alias("pj"))
    return both, one.join(two, "mid").where("di < dj").withColumn("product", F.col("pi") * F.col("pj"))


def _implied(wedges: DataFrame) -> DataFrame:
    weaker = F.max(F.least("pi", "pj")).alias("weaker")
    return wedges.groupBy("i", "j").agg(F.max("product").alias("product"), weaker, *[F.first(c).alias(c) for c in ("di", "dj", "zi", "zj", "kind")])


def _alike() -> Column:
    limit = F.when(F.col("kind") == "building", SIZE_LIMIT["building"]).otherwise(SIZE_LIMIT["parcel"])
    return F.coalesce(F.abs(F.col("zi") - F.col("zj")), F.lit(0.0)) <= limit


def lowered(active: DataFrame, both: DataFrame, wedges: DataFrame, known: DataFrame) -> DataFrame:
    """The links with the less sure one of every contradicted wedge lowered to what the implied pair allows.

    ``known``: the implied pairs with ``own``, their posterior as candidates.
    A pair is contradicted if it may be no more than ``bound``, and that is
    less than the product: nothing if it is no candidate and the sizes differ;
    what a surer partner of either end leaves; its own posterior if that and
    the weaker link are less likely both true than both false.
    """
    of_i = both.select(F.col("id_a").alias("i"), F.col("ds_b").alias("dj"), F.col("id_b").alias("_i"), F.col("p").alias("qi"))
    of_j = both.select(F.col("id_a").alias("j"), F.col("ds_b").alias("di"), F.col("id_b").alias("_j"), F.col("p").alias("qj"))
    judged = known.join(of_i, ["i", "dj"], "left").join(of_j, ["j", "di"], "left")
    rival = F.greatest(F.when(F.col("_i") != F.col("j"), F.col("qi")), F.when(F.col("_j") != F.col("i"), F.col("qj")))
    bound = F.least(
        F.when(F.col("own").isNull() & ~_alike(), 0.0),
        F.when(rival > F.col("product"), 1 - rival),
        F.when(F.col("own") + F.col("weaker") < 1, F.col("own")),
    )
    against = judged.select("i", "j", bound.alias("bound"), "product").where("bound < product").drop("product")
    surer = F.col("pi") >= F.col("pj")
    weak, mid = F.when(surer, F.col("j")).otherwise(F.col("i")), F.col("mid")
    # The link's ends in the order of the pairs: by dataset, which the wedge has of i and j only, so both orders are offered.
    fallen = wedges.join(against, ["i", "j"]).select(weak.alias("e"), mid.alias("f"), (F.col("bound") / F.greatest("pi", "pj")).alias("most"))
    offered = fallen.select(F.col("e").alias("id_a"), F.col("f").alias("id_b"), "most").unionByName(fallen.select(F.col("f").alias("id_a"), F.col("e").alias("id_b"), "most"))
    most = offered.groupBy("id_a", "id_b").agg(F.min("most").alias("most"))
    return durable(active.join(most, ["id_a", "id_b"], "left").withColumn("before", F.col("p")).withColumn("p", F.least("p", "most")).drop("most"))


_PAIR = ["id_a", "id_b", "ds_a", "ds_b", "kind", "type", "size_a", "size_b", "rank", *SIMILARITIES]


def corrections(pairs: DataFrame) -> DataFrame:
    """The pairs whose posterior ``p`` transitivity changes, with the one ``before``; inferred pairs have none.

    Only links that are the best of both ends between their sources take
    part, so a record has one such link a source and the wedges are linear in
    the links.  Lowering comes first: nothing is raised by a link that falls,
    and what has fallen is not raised again.
    """
    active = durable(_mutual_best(pairs.where(F.col("p") >= ACTIVE)).select(*_PAIR, "p"))
    both, wedges = _wedges(active)
    wedges = durable(wedges)
    own = pairs.select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), F.col("p").alias("own"), "rank", *SIMILARITIES)
    known = durable(_implied(wedges).join(own, ["i", "j"], "left"))
    after = lowered(active, both, wedges, known)
    fallen = after.where("p < before")
    implied = _implied(_wedges(after)[1]).select("i", "j", F.col("product").alias("p"))
    final = known.drop("product", "weaker").join(implied, ["i", "j"]).join(fallen.select(F.col("id_a").alias("i"), F.col("id_b").alias("j")), ["i", "j"], "left_anti")
    changed = final.where(F.when(F.col("own").isNull(), _alike()).otherwise(F.col("p") > F.col("own")))
    # An inferred link comes behind the candidates of equal posterior.
    raised = changed.select(
        F.col("i").alias("id_a"), F.col("j").alias("id_b"), F.col("di").alias("ds_a"), F.col("dj").alias("ds_b"), "kind", F.concat_ws("|", "di", "dj").alias("type"), F.col("zi").alias("size_a"), F.col("zj").alias("size_b"),
        F.coalesce("rank", F.lit(1e9)).alias("rank"), *SIMILARITIES, "p", F.col("own").alias("before"),
    )
    return raised.unionByName(fallen.select(*raised.columns))


def corrected(pairs: DataFrame, fixed: DataFrame) -> DataFrame:
    """``pairs`` with the posteriors of ``fixed``, inferred pairs included."""
    new = fixed.where("before is not null").select("id_a", "id_b", F.col("p").alias("_p"))
    return pairs.join(new, ["id_a", "id_b"], "left").withColumn("p", F.coalesce("_p", "p")).drop("_p").select(*_PAIR, "p").unionByName(fixed.where("before is null").select(*_PAIR, "p"))


def closed(pairs: DataFrame) -> DataFrame:
    """Pairs with posteriors ``p`` corrected for transitivity once; pairs without a ``kind`` are of parcels."""
    pairs = pairs if "kind" in pairs.columns else pairs.withColumn("kind", F.lit("parcel"))
    return corrected(pairs, durable(corrections(pairs)))


def match_posteriors(vectors: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Posterior ``p`` of every candidate and inferred pair, after the last expectation of the fit."""
    vectors = durable(vectors)
    lattice = durable(lattice_counts(vectors))
    parameters, seen = durable_counted(first_fit(lattice), n=F.count(F.lit(1)))
    for k in range(most_rounds):
        pairs = with_posterior(vectors, parameters, seen["n"])
        fixed = durable(corrections(pairs))
        if k + 1 == most_rounds:
            break
        new = durable(next_fit(lattice, parameters, fixed))
        both = parameters.select("type", F.concat("weight", "mean").alias("a")).join(new.select("type", F.concat("weight", "mean").alias("b")), "type")
        change = both.select(F.array_max(F.zip_with("a", "b", lambda a, b: F.abs(a - b))).alias("c")).agg(F.max("c")).first()[0]
        if change is None or change < STILL:
            break
        parameters = new
    return corrected(pairs, fixed)


def matched(features: DataFrame, classes: list[str], least: float = 0.5) -> DataFrame:
    """(id_a, id_b, confidence), id_a < id_b: features of two datasets that are one object.

    ``features``: the columns of source_feature.  Of the rows of a feature the
    one with the smallest id counts.  A pair counts with a posterior of at
    least ``least`` if neither end has a better partner in the other's
    dataset.  Features without place and number have no candidates; an empty
    table gives no rows.
    """
    pairs = match_posteriors(similarity_vectors(records(features, classes)))
    sure = _mutual_best(pairs.where(F.col("p") >= least))
    return sure.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.col("p").alias("confidence"))
