"""Scans of the text formats of surveyors, as DataFrames.

Every reader declares its schema, skips what it cannot read and never samples
the input to infer types.  A scan stays splittable: lines are read by
``spark.read.text`` and parsed with built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.functions import rings

_FEATURE = "id string, properties map<string,string>, geometry string"


def _coordinates(geometry: Column) -> Column:
    """GEOM of a GeoJSON geometry text: points, lines and polygons, one or several; all parts are kept.

    The rings of a MultiPolygon come one after the other as ``flat_parts``
    puts them.  Collections and unknown kinds are null; ``unread_kinds`` counts
    them.
    """
    kind = F.get_json_object(geometry, "$.type")
    pair = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    ring = lambda r: F.transform(r, pair)
    body = F.get_json_object(geometry, "$.coordinates")
    flat = F.from_json(body, "array<double>")
    line = F.from_json(body, "array<array<double>>")
    lines = F.from_json(body, "array<array<array<double>>>")
    several = F.from_json(body, "array<array<array<array<double>>>>")
    found = (
        F.when(kind == "Point", F.array(F.array(pair(flat))))
        .when(kind == "LineString", F.array(ring(line)))
        .when(kind == "MultiPoint", F.transform(ring(line), lambda p: F.array(p)))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(lines, ring))
        .when(kind == "MultiPolygon", rings.flat_parts(F.transform(several, lambda p: F.transform(p, ring))))
    )
    return F.when(found.isNotNull() & (F.size(found) > 0), F.struct(kind.alias("kind"), found.alias("rings")))


def unread_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(kind, n) of the features of a GeoJSON-lines file that have a geometry which no reader here can read."""
    parsed = _json_lines(spark, path).select(F.from_json("line", _FEATURE)["geometry"].alias("g")).where("g IS NOT NULL AND g <> 'null'")
    return parsed.where(_coordinates(F.col("g")).isNull()).groupBy(F.coalesce(F.get_json_object("g", "$.type"), F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def declared_crs(spark: SparkSession, path: str) -> DataFrame:
    """(file, crs) of the crs member of GeoJSON documents; EPSG:4326 where none is declared."""
    named = F.get_json_object("value", "$.crs.properties.name")
    code = F.regexp_extract(named, r"EPSG:+(\d+)", 1)
    crs = F.when(named.isNull() | F.contains(named, F.lit("CRS84")), "EPSG:4326").when(code != "", F.concat(F.lit("EPSG:"), code)).otherwise(named)
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), crs.alias("crs"))


def _features(parsed: DataFrame, dataset_id: str) -> DataFrame:
    props = F.col("f.properties")
    fid = F.coalesce("f.id", props["gcc_gis_id"], props["object_id"], props["id"], F.concat(F.lit(f"{dataset_id}#"), F.substring(F.sha2(F.col("f.geometry"), 256), 1, 12)))
    return parsed.select(F.lit(dataset_id).alias("dataset_id"), fid.alias("fid"), _coordinates(F.col("f.geometry")).alias("geom"), F.coalesce(props, F.create_map().cast("map<string,string>")).alias("properties")).where("geom IS NOT NULL")


def read_geojson_lines(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """One feature per line; blank lines, brackets, broken JSON and features without geometry are skipped.

    A feature without an identifier gets one from its geometry's hash, so that
    the id does not depend on how the file is split.
    """
    return _features(_json_lines(spark, path).select(F.from_json("line", _FEATURE).alias("f")), dataset_id)


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",$", "").alias("line")).where(F.startswith("line", F.lit("{")))


def probe_geojson_lines(spark: SparkSession, path: str, dataset_id: str, lines: int = 5_000) -> DataFrame:
    """(attribute, n, null_rate, distinct_values) of the first lines of a file, and of ``geom`` by kind: a look before a load."""
    features = read_geojson_lines(spark, path, dataset_id).limit(lines)
    total = features.agg(F.count(F.lit(1)).alias("rows"))
    cells = features.select(F.explode("properties").alias("attribute", "value")).unionByName(features.select(F.lit("geom").alias("attribute"), F.col("geom.kind").alias("value")))
    own = cells.groupBy("attribute").agg(F.count_if(F.trim("value") != "").alias("n"), F.countDistinct(F.substring("value", 1, 64)).alias("distinct_values"))
    # One row against the attributes.
    return own.join(F.broadcast(total)).select("attribute", "n", (1 - F.col("n") / F.col("rows")).alias("null_rate"), "distinct_values")


def read_geojson(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """A FeatureCollection in one document per file."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.features"), f"array<struct<{_FEATURE.replace(' ', ':').replace(',:', ',')}>>")).alias("f"))
    return _features(whole, dataset_id)


# Names under which a WKT column goes, the first that a file has counts.
WKT_COLUMNS = ["wkt", "geom", "geometry", "the_geom", "shape", "wkt_geom"]


def read_wkt_csv(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """CSV, TSV or pipe-separated rows with a WKT column; rows without geometry are kept."""
    name = path.removesuffix(".gz")
    sep = "\t" if name.endswith((".tsv", ".tab")) else "|" if name.endswith(".psv") else ","
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    shape = next((c for name in WKT_COLUMNS for c in df.columns if c.strip().lower() == name), None)
    others = [c for c in df.columns if c != shape]
    props = F.map_filter(F.create_map(*[x for c in others for x in (F.lit(c), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull()) if others else F.create_map().cast("map<string,string>")
    geom = rings.from_wkt(F.col(f"`{shape}`")) if shape else F.lit(None).cast("struct<kind:string,rings:array<array<struct<x:double,y:double>>>>")
    fid = next((F.col(f"`{c}`") for c in others if c.lower() in ("id", "fid", "gcc_gis_id")), F.substring(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256), 1, 12))
    return df.select(F.lit(dataset_id).alias("dataset_id"), fid.alias("fid"), geom.alias("geom"), props.alias("properties"))


# Standard deviation in metres by the quality digit of a GGA sentence.
GGA_SIGMA = {1: 3.5, 2: 0.8, 3: 3.5, 4: 0.014, 5: 0.35, 6: 1.5, 7: 3.0, 8: 3.0}


def read_nmea(spark: SparkSession, path: str) -> DataFrame:
    """GGA sentences with a right checksum: time, lon, lat, height, quality and standard deviations."""
    lines = spark.read.text(path).select(F.trim("value").alias("s")).where(F.col("s").rlike(r"^\$..GGA,.*\*[0-9A-Fa-f]{2}$"))
    body = F.regexp_extract("s", r"^\$(.*)\*", 1)
    bytes_ = F.transform(F.sequence(F.lit(1), F.length(body)), lambda k: F.ascii(F.substring(body, k, F.lit(1))))
    checksum = F.aggregate(bytes_, F.lit(0), lambda a, b: a.bitwiseXOR(b))
    told = F.conv(F.substring_index("s", "*", -1), 16, 10).cast("int")
    p = lambda k: F.nullif(F.get(F.split(body, ","), F.lit(k)), F.lit(""))
    degrees = lambda v, sign, minus: (F.floor(v / 100) + (v % 100) / 60) * F.when(sign == minus, -1.0).otherwise(1.0)
    quality = p(6).try_cast("int")
    sigma = F.element_at(F.create_map(*[F.lit(x) for kv in GGA_SIGMA.items() for x in kv]), quality) * F.greatest(F.coalesce(p(8).try_cast("double"), F.lit(1.0)), F.lit(1.0))
    out = lines.where(checksum == told).select(
        p(1).alias("time"), degrees(p(4).try_cast("double"), p(5), "W").alias("lon"), degrees(p(2).try_cast("double"), p(3), "S").alias("lat"), p(9).try_cast("double").alias("height"), quality.alias("quality"), sigma.alias("sigma_h"), (sigma * 1.8).alias("sigma_v")
    )
    return out.where("quality > 0 AND lon IS NOT NULL AND lat IS NOT NULL")


def read_rinex_header(spark: SparkSession, path: str) -> DataFrame:
    """Marker name, approximate ECEF position and receiver of each observation file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.rtrim(F.substring("value", 61, 20)).alias("label"), F.substring("value", 1, 60).alias("body"))
    kept = lines.where(F.col("label").isin("MARKER NAME", "APPROX POSITION XYZ", "REC # / TYPE / VERS"))
    pick = lambda label: F.max(F.when(F.col("label") == label, F.col("body")))
    out = kept.groupBy("file").agg(pick("MARKER NAME").alias("marker"), pick("APPROX POSITION XYZ").alias("xyz"), pick("REC # / TYPE / VERS").alias("receiver"))
    at = lambda k: F.get(F.split(F.trim("xyz"), r"\s+"), F.lit(k - 1)).try_cast("double")
    return out.select("file", F.trim("marker").alias("marker"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), F.trim("receiver").alias("receiver"))


# Header names of control point files.
CONTROL_NAMES = {
    "gcp_id": ["gcp_id", "id", "name", "point", "point_id"], "source_x": ["source_x", "x", "map_x", "col"], "source_y": ["source_y", "y", "map_y", "row"],
    "target_x": ["target_x", "easting", "e", "lon"], "target_y": ["target_y", "northing", "n", "lat"], "sigma_m": ["sigma_m", "sigma", "accuracy"],
}


def read_control_csv(spark: SparkSession, path: str, sigma: float = 0.05) -> DataFrame:
    """Control points under any of the usual headers; rows without numbers are skipped, a missing sigma is the default."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    by = {c.strip().lower(): c for c in df.columns}
    found = {k: next((by[n] for n in names if n in by), None) for k, names in CONTROL_NAMES.items()}
    number = lambda k: F.col(f"`{found[k]}`").try_cast("double") if found[k] else F.lit(None).cast("double")
    out = df.select(F.col(f"`{found['gcp_id']}`").alias("gcp_id") if found["gcp_id"] else F.lit(None).cast("string").alias("gcp_id"), *[number(k).alias(k) for k in ("source_x", "source_y", "target_x", "target_y")], F.coalesce(number("sigma_m"), F.lit(sigma)).alias("sigma_m"))
    return out.dropna(subset=["source_x", "source_y", "target_x", "target_y"])


def read_tile_pyramid(spark: SparkSession, path: str, tms: bool = False) -> DataFrame:
    """Zoom, column and row of the tiles of an XYZ or TMS folder, with content and checksum."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(path)
    part = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.[A-Za-z]+$", k).try_cast("int")
    out = files.select(part(1).alias("zoom"), part(2).alias("x"), part(3).alias("y"), "length", F.sha2("content", 256).alias("sha256"), "content").where("zoom IS NOT NULL")
    return out.withColumn("y", F.expr("shiftleft(1, zoom) - 1 - y")) if tms else out


def clipped(features: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Features whose envelope meets a window (closed intervals)."""
    xs, ys = (F.transform(F.flatten("geom.rings"), lambda p: p[c]) for c in "xy")
    return features.where((F.array_min(xs) <= x2) & (F.array_max(xs) >= x1) & (F.array_min(ys) <= y2) & (F.array_max(ys) >= y1))


def feature_claims(features: DataFrame) -> DataFrame:
    """One geometry claim and one claim per property that says something, for each feature."""
    shape = features.where("geom IS NOT NULL").select("dataset_id", "fid", F.lit("geometry").alias("property_path"), F.lit(None).cast("string").alias("value_text"), "geom")
    said = features.select("dataset_id", "fid", F.explode("properties").alias("property_path", "value_text"), F.lit(None).cast(features.schema["geom"].dataType).alias("geom")).where(F.trim("value_text") != "")
    return shape.unionByName(said)


READERS = {".geojsonl": read_geojson_lines, ".jsonl": read_geojson_lines, ".ndjson": read_geojson_lines, ".geojson": read_geojson, ".json": read_geojson, ".csv": read_wkt_csv, ".tsv": read_wkt_csv, ".psv": read_wkt_csv}


def read_path(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """Dispatch by extension, compressed files included; the error lists what is known."""
    plain = path.removesuffix(".gz")
    for extension, reader in READERS.items():
        if plain.endswith(extension):
            return reader(spark, path, dataset_id)
    if plain.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}; known extensions: {', '.join([*READERS, '.parquet'])}")
