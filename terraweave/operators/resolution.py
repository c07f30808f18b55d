"""Claims of several sources weighed by family, lineage and precedence, and resolved field by field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.functions import polygons as P
from terraweave.functions import values as V
from terraweave.operators import evidence as E
from terraweave.operators.eav import field_names, with_parsed_value
from terraweave.session import durable, durable_counted

FAMILIES = ("position", "shape", "tenure", "extent", "classification", "identity", "network")
# Reliability of each type of source by family, nominal accuracy in metres and half-life in days.
RELIABILITY = {
    "gnss_cors": (0.99, 0.60, 0.05, 0.55, 0.05, 0.10, 0.10, 0.02, 3650), "ground_truth": (0.96, 0.80, 0.45, 0.75, 0.80, 0.75, 0.55, 0.20, 1095),
    "orthorectified_imagery": (0.93, 0.92, 0.02, 0.80, 0.55, 0.05, 0.35, 0.10, 1095), "drone_imagery": (0.88, 0.90, 0.02, 0.72, 0.50, 0.05, 0.30, 0.15, 730),
    "dsm": (0.85, 0.75, 0.02, 0.55, 0.60, 0.02, 0.10, 0.25, 730), "dtm": (0.85, 0.60, 0.02, 0.45, 0.35, 0.02, 0.10, 0.25, 1460), "point_cloud": (0.92, 0.88, 0.02, 0.70, 0.60, 0.02, 0.20, 0.08, 730),
    "ai_extraction": (0.72, 0.70, 0.02, 0.62, 0.72, 0.05, 0.45, 0.60, 1095), "cadastral_map": (0.55, 0.72, 0.88, 0.90, 0.62, 0.95, 0.15, 3.0, 2555),
    "revenue_record": (0.20, 0.25, 0.96, 0.93, 0.70, 0.97, 0.05, 8.0, 1825), "municipal_gis": (0.74, 0.76, 0.42, 0.66, 0.86, 0.88, 0.70, 1.0, 1460),
    "building_footprint": (0.76, 0.82, 0.05, 0.70, 0.68, 0.35, 0.20, 1.2, 1460), "utility_network": (0.62, 0.60, 0.05, 0.25, 0.72, 0.55, 0.94, 2.5, 1095),
    "transport_network": (0.70, 0.68, 0.05, 0.30, 0.78, 0.60, 0.90, 2.0, 1460), "admin_boundary": (0.68, 0.70, 0.30, 0.60, 0.90, 0.92, 0.30, 3.0, 1825), "hydrology": (0.66, 0.64, 0.20, 0.55, 0.84, 0.50, 0.60, 3.0, 730),
}
UNKNOWN = (0.5, 5.0, 730)
# Types of sources of each family, the highest authority first.
PRECEDENCE = {
    "position": ["gnss_cors", "ground_truth", "orthorectified_imagery", "point_cloud", "drone_imagery"], "tenure": ["revenue_record", "cadastral_map"], "identity": ["revenue_record", "cadastral_map", "municipal_gis"],
    "extent": ["revenue_record", "cadastral_map"], "classification": ["municipal_gis", "revenue_record"], "network": ["utility_network", "transport_network"], "shape": ["orthorectified_imagery", "point_cloud", "ai_extraction"],
}
#: The family of a field by the kind it has in the canonical schema.
FAMILY_OF_KIND = {"identity": "identity", "extent": "extent", "use": "classification", "admin": "classification", "built": "classification", "status": "tenure"}


def _looked_up(table: dict, key: Column, otherwise: Column, kind: str = "double") -> Column:
    """The entry of a fixed table, which enters the plan as one literal."""
    told = F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in table.items())), F.lit(";"), F.lit("="))
    return F.coalesce(F.element_at(told, key).cast(kind), otherwise)


def family(kind: Column) -> Column:
    return _looked_up(FAMILY_OF_KIND, kind, F.lit("classification"), "string")


def prior(source_type: Column, of: Column) -> Column:
    """Reliability of a type of source in a family; one half where it is not declared."""
    return _looked_up({f"{s}|{f}": float(v[k]) for s, v in RELIABILITY.items() for k, f in enumerate(FAMILIES)}, F.concat_ws("|", source_type, of), F.lit(UNKNOWN[0]))


def nominal_accuracy(source_type: Column) -> Column:
    return _looked_up({s: float(v[7]) for s, v in RELIABILITY.items()}, source_type, F.lit(UNKNOWN[1]))


def half_life(source_type: Column) -> Column:
    return _looked_up({s: float(v[8]) for s, v in RELIABILITY.items()}, source_type, F.lit(float(UNKNOWN[2])))


def authority_rank(source_type: Column, of: Column) -> Column:
    """Place of a type of source in the precedence of a family, from 0; null where it has none."""
    return _looked_up({f"{s}|{f}": k for f, types in PRECEDENCE.items() for k, s in enumerate(types)}, F.concat_ws("|", source_type, of), F.lit(None).cast("int"), "int")


def lineage_roots(datasets: DataFrame, most: int = 64) -> DataFrame:
    """(dataset_id, roots): the sources without parents from which each dataset descends, itself where it has none.

    ``datasets``: dataset_id and lineage_parents.  The ancestors grow by one
    generation a step until none is new (``most`` generations); datasets that
    only descend from each other in a circle have its smallest name.
    """
    parents = durable(datasets.where("dataset_id IS NOT NULL").select(F.col("dataset_id").alias("_d"), F.explode("lineage_parents").alias("_p")).where("_p IS NOT NULL AND _p <> _d").distinct())
    own = datasets.where("dataset_id IS NOT NULL").select("dataset_id", F.col("dataset_id").alias("root")).distinct()
    at, seen = durable_counted(own, n=F.count(F.lit(1)))
    for _ in range(most):
        more = at.join(parents, F.col("root") == F.col("_d")).select("dataset_id", F.col("_p").alias("root"))
        grown, now = durable_counted(at.unionByName(more).distinct(), n=F.count(F.lit(1)))
        if now["n"] == seen["n"]:
            break
        at, seen = grown, now
    first = at.join(parents.select("_d").distinct(), F.col("root") == F.col("_d"), "left_anti").groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_set("root")), ",").alias("roots"))
    return at.groupBy("dataset_id").agg(F.min("root").alias("_any")).join(first, "dataset_id", "left").select("dataset_id", F.coalesce("roots", "_any").alias("roots"))


def field_claims(claims: DataFrame, fields: DataFrame) -> DataFrame:
    """(entity_id, field_name, kind, dataset_id, value, id, observed_on, accuracy_m, confidence): one usable claim of each source.

    Of several claims of a source about a field the latest counts, then the
    smallest id.  Amounts are compared in whole hundredths.  A confidence is a
    share or a percentage, an accuracy lies above 0 and under 100; others are
    null.
    """
    spelled = claims.where("entity_id IS NOT NULL AND dataset_id IS NOT NULL").select("*", V.bare_key(F.substring_index("property_path", ".", -1)).alias("spelling"))
    keyed = spelled.join(field_names(fields), "spelling")
    parsed = with_parsed_value(keyed)
    value = F.when(F.col("dtype") == "float", F.round(F.col("value").try_cast("double") * 100).cast("bigint").cast("string")).otherwise(F.col("value"))
    conf = F.col("extraction_confidence")
    share = F.when(conf.between(0, 1), conf).when(conf.between(1, 100), conf / 100)
    accuracy = F.when((F.col("accuracy_m") > 0) & (F.col("accuracy_m") < 100), F.col("accuracy_m"))
    row = parsed.select("entity_id", "field_name", "kind", "dataset_id", value.alias("value"), "id", "observed_on", accuracy.alias("accuracy_m"), share.alias("confidence"))
    order = F.when(F.col("value").isNotNull(), F.struct(F.coalesce("observed_on", F.lit("0001-01-01").cast("date")), -F.col("id")))
    once = row.groupBy("entity_id", "field_name", "kind", "dataset_id").agg(F.max_by(F.struct("value", "id", "observed_on", "accuracy_m", "confidence"), order).alias("r"))
    return once.select("entity_id", "field_name", "kind", "dataset_id", "r.*").where("value IS NOT NULL")


def weighed(claims: DataFrame, datasets: DataFrame, as_of: str, discounted: bool = True) -> DataFrame:
    """``field_claims`` with source_type, family, mass and the rank of authority.

    The mass counts reliability, recency, accuracy and the extraction's doubt;
    of sources with the same roots in one group each counts one over the
    square root of their number.
    """
    known = datasets.select("dataset_id", "source_type", F.col("positional_accuracy_m").alias("_declared")).join(lineage_roots(datasets), "dataset_id", "left")
    joined = claims.join(known, "dataset_id", "left").withColumn("family", family(F.col("kind")))
    kind = F.col("source_type")
    accuracy = F.coalesce("accuracy_m", "_declared", nominal_accuracy(kind))
    penalty = 0.6 * (1 - F.coalesce("confidence", F.lit(1.0)))
    m = E.mass(prior(kind, F.col("family")), E.recency(F.col("observed_on"), F.lit(as_of).cast("date"), half_life(kind)), E.accuracy_weight(accuracy), 0.0, penalty)
    alike = F.count(F.lit(1)).over(Window.partitionBy("entity_id", "field_name", F.coalesce("roots", "dataset_id")))
    return joined.select(*claims.columns, "source_type", "family", (m / F.sqrt(alike) if discounted else m).alias("mass"), authority_rank(kind, F.col("family")).alias("authority"))


def decided(evidence: DataFrame) -> DataFrame:
    """One decision a group of ``weighed``: value, strategy, belief, plausibility, options, claims, escalated.

    A single claim stands with its mass, unanimous claims stand; else the claim
    of the highest authority of the family, with its mass and 0.2 more up to
    0.99; else the value of most belief.  What fusion leaves below 0.40 or
    with a gap above 0.45 is for a person to decide.
    """
    keys = ["entity_id", "field_name"]
    fused = E.resolved(evidence, keys)
    first = evidence.where("authority IS NOT NULL").groupBy(*keys).agg(F.min_by(F.struct("value", "mass"), F.struct("authority", "dataset_id")).alias("a"))
    out = fused.join(first, keys, "left")
    by_rank = (F.col("strategy") == "fusion") & F.col("a").isNotNull()
    raised = F.least(F.lit(0.99), F.col("a.mass") + 0.2)
    return out.select(
        *keys, F.when(by_rank, F.col("a.value")).otherwise(F.col("value")).alias("value"), F.when(by_rank, "precedence").otherwise(F.col("strategy")).alias("strategy"), F.when(by_rank, raised).otherwise(F.col("belief")).alias("belief"),
        F.when(by_rank, F.greatest(raised, F.col("plausibility"))).otherwise(F.col("plausibility")).alias("plausibility"), "options", "claims", (F.col("escalated") & ~by_rank).alias("escalated"),
    )


def fused_geometry(claims: DataFrame, tolerance: float = 0.5, least_iou: float = 0.9) -> DataFrame:
    """(entity_id, dataset_id, members, claims, corroboration, spread) of the geometry that stands for each entity.

    ``claims``: entity_id, dataset_id, geom (metric), mass, accuracy_m; one of
    each dataset, so a group is no larger than the list of datasets.  The
    claims, weightiest first, join the first cluster whose leader lies within
    the tolerance (at least ``tolerance``, else the two largest deviations
    together) or shares ``least_iou`` of the area with it; the weightiest
    member of the cluster of most mass stands.  Claims without a polygon take
    no part.
    """
    row = F.struct(F.negative("mass").alias("order"), "dataset_id", "accuracy_m", "geom")
    groups = claims.where("entity_id IS NOT NULL AND geom IS NOT NULL").groupBy("entity_id").agg(F.array_sort(F.collect_list(row)).alias("claims"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for entity, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shapes = []
                for r in rows:
                    points = np.array([(p["x"], p["y"]) for p in (r["geom"]["rings"] or [[]])[0] or []], float)
                    if len(points) >= 4 and np.isfinite(points).all() and abs(P.ring_area(points)) > 0:
                        shapes.append((r, points, points[:-1].mean(0)))
                if not shapes:
                    continue
                accuracy = sorted((r["accuracy_m"] or 0.0 for r, _, _ in shapes), reverse=True)[:2]
                near = max(tolerance, float(np.hypot(*accuracy)) if len(accuracy) > 1 else 0.0)
                clusters: list[list[int]] = []
                for k, (_, ring, centre) in enumerate(shapes):
                    for c in clusters:
                        lead, middle = shapes[c[0]][1:]
                        edge = [np.column_stack([np.zeros(len(g) - 1), g[:-1], g[1:]]) for g in (lead, ring)]
                        if np.hypot(*(middle - centre)) <= near:
                            c.append(k)
                            break
                        a, b, both = (float(v[0]) for v in P.overlay_areas(*edge, 1))
                        if both / (a + b - both) >= least_iou:
                            c.append(k)
                            break
                    else:
                        clusters.append([k])
                best = max(clusters, key=lambda c: (-sum(shapes[k][0]["order"] for k in c), -c[0]))
                n = len(shapes)
                spread = max((float(np.hypot(*(shapes[i][2] - shapes[j][2]))) for i in range(n) for j in range(i)), default=0.0)
                out.append((entity, shapes[best[0]][0]["dataset_id"], len(best), n, (len(best) - 1) / (n - 1) if n > 1 else 0.0, spread))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["entity_id", "dataset_id", "members", "claims", "corroboration", "spread"])

    return groups.mapInArrow(run, "entity_id string, dataset_id string, members bigint, claims bigint, corroboration double, spread double")


def case_priority(severity: Column, uncertainty: Column, area: Column, batch: Column) -> Column:
    """Priority of a case from its severity, what is open, the area it concerns and how many cases share its batch."""
    return 0.34 * severity + 0.28 * uncertainty + 0.24 * F.least(F.lit(1.0), F.log10(area + 1) / 4) + 0.14 * F.least(F.lit(1.0), F.log10(batch + 1) / 3)


def queue(decisions: DataFrame, evidence: DataFrame, area: float = 0.0) -> DataFrame:
    """The escalated decisions by priority: severity of the conflict, uncertainty, batch size and rank.

    Cases of one field and number of options form a batch; ranks go by
    priority, then entity and field.
    """
    k = E.conflict_mass(evidence, ["entity_id", "field_name"], ["dataset_id"])
    open_ = decisions.where("escalated").join(k, ["entity_id", "field_name"])
    batch = F.count(F.lit(1)).over(Window.partitionBy("field_name", "options"))
    cases = open_.select("entity_id", "field_name", F.least(F.lit(1.0), F.col("conflict") + 0.2).alias("severity"), (F.col("plausibility") - F.col("belief")).alias("uncertainty"), batch.alias("batch"))
    return cases.withColumn("priority", case_priority(F.col("severity"), F.col("uncertainty"), F.lit(area), F.col("batch")))


def fabric_confidence(decisions: DataFrame, evidence: DataFrame, fields: dict[str, float], as_of: str) -> DataFrame:
    """Four confidence dimensions of every entity from its decisions: agreement, completeness, currency and placement; others are null.

    ``fields``: the weight of each field in completeness.
    """
    own = decisions.groupBy("entity_id").agg(F.avg("belief").alias("_b"), F.avg(((F.col("plausibility") - F.col("belief")) < 0.3).cast("double")).alias("_sure"), F.sum(_looked_up(fields, F.col("field_name"), F.lit(0.0))).alias("_w"))
    newest = E.recency(F.max("observed_on"), F.lit(as_of).cast("date"), F.lit(1460.0))
    told = evidence.groupBy("entity_id").agg(F.countDistinct("dataset_id").alias("n"), F.min("accuracy_m").alias("_acc"), newest.alias("_new"))
    n = F.col("n")
    agreement = F.when(n <= 1, 0.30).otherwise(0.4 * F.least(F.lit(1.0), (n - 1) / 2) + 0.35 * F.col("_b") + 0.25 * F.col("_sure"))
    none = F.lit(None).cast("double")
    return own.join(told, "entity_id").select(
        "entity_id", "n", F.when(F.col("_acc").isNotNull(), E.accuracy_weight(F.col("_acc"), 0.5)).alias("placement"), agreement.alias("agreement"), none.alias("topological"), (F.col("_w") / sum(fields.values())).alias("completeness"), (0.3 + 0.7 * F.col("_new")).alias("currency"), none.alias("lineage")
    )
