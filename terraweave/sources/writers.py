"""Sinks: GeoJSON lines, CityJSON, keyed merges and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.functions import rings


def geojson_feature(fid: str = "fid", geom: str = "geom", properties: list[str] | None = None) -> Column:
    """The GeoJSON text of a row; columns that begin with an underscore are never written."""
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    g = F.col(geom)
    body = (
        F.when(g["kind"] == "Point", F.to_json(F.get(F.get(F.transform(g["rings"], ring), F.lit(0)), F.lit(0))))
        .when(g["kind"] == "LineString", F.to_json(F.get(F.transform(g["rings"], ring), F.lit(0))))
        .when(g["kind"] == "MultiPoint", F.to_json(F.flatten(F.transform(g["rings"], ring))))
        .when(g["kind"] == "MultiPolygon", F.to_json(F.transform(rings.parts_of(g), lambda p: F.transform(p, ring))))
        .otherwise(F.to_json(F.transform(g["rings"], ring)))
    )
    shown = [c for c in properties or [] if not c.startswith("_")]
    props = F.to_json(F.struct(*[F.col(c) for c in shown])) if shown else F.lit("{}")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col(fid).cast("string").alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.concat(F.lit('{"type":"Feature","id":'), quoted, F.lit(',"geometry":{"type":"'), g["kind"], F.lit('","coordinates":'), body, F.lit('},"properties":'), props, F.lit("}"))


def write_geojson_lines(df: DataFrame, path: str, fid: str = "fid", geom: str = "geom") -> None:
    others = [c for c in df.columns if c not in (fid, geom)]
    df.where(F.col(geom).isNotNull()).select(geojson_feature(fid, geom, others).alias("value")).write.mode("overwrite").text(path)


def merged(target: DataFrame, updates: DataFrame, keys: list[str], overwrite: bool = True) -> DataFrame:
    """Upsert by key: rows of ``updates`` win, or only fill in where ``overwrite`` is false.

    Of several updates of one key any may stand; make keys unique before.
    """
    updates = updates.dropDuplicates(keys)
    if overwrite:
        return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates.select(*target.columns))
    return target.unionByName(updates.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def city_vertices(solids: DataFrame, scale: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Shared quantised vertices of extruded boxes and the vertex ids of every object.

    ``solids``: fid, x1, y1, x2, y2, height.  A vertex id is dense over all
    vertices in the order of x, y, z; ids come from counts per range of x, so
    no window runs over the whole table.
    """
    corner = [(x, y, z) for z in ("0.0", "height") for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))]
    quantum = lambda e: F.round(F.expr(e) / scale).cast("bigint")
    points = F.array(*[F.struct(F.lit(k).alias("k"), quantum(x).alias("x"), quantum(y).alias("y"), quantum(z).alias("z")) for k, (x, y, z) in enumerate(corner)])
    placed = solids.select("fid", F.explode(points).alias("p")).select("fid", "p.*")
    from pyspark.sql import Window

    distinct = placed.select("x", "y", "z").distinct()
    inside = Window.partitionBy("x").orderBy("y", "z")
    per_x = distinct.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    block = F.floor(F.col("x") / 65536)
    blocks = per_x.groupBy(block.alias("b")).agg(F.sum("n").alias("n"))
    # Blocks of x are few against vertices; only their running total is ordered globally.
    before_block = blocks.withColumn("base", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("b", F.coalesce("base", F.lit(0)).alias("base"))
    before_x = per_x.withColumn("b", block).withColumn("inner", F.sum("n").over(Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)))
    base = before_x.join(before_block, "b").select("x", (F.col("base") + F.coalesce("inner", F.lit(0))).alias("base"))
    vertices = distinct.withColumn("r", F.row_number().over(inside)).join(base, "x").select((F.col("base") + F.col("r") - 1).alias("vertex"), "x", "y", "z")
    objects = placed.join(vertices, ["x", "y", "z"]).groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "vertex"))), lambda s: s["vertex"]).alias("vertices"))
    return vertices, objects


def city_feature(fid: Column, ring: Column, height: Column, attributes: Column, scale: float = 0.001) -> Column:
    """One line of a CityJSON text sequence: an outer ring extruded to a solid with quantised vertices of its own.

    The base faces down, walls follow the sides, the roof faces up; a ring that
    runs clockwise is turned first.  Null without a ring of three sides or a
    height above 0.
    """
    outer = rings.counter_clockwise(ring)
    n = F.size(outer) - 1
    corner = lambda p, z: F.array(F.round(p["x"] / scale).cast("bigint"), F.round(p["y"] / scale).cast("bigint"), F.round(z / scale).cast("bigint"))
    base = F.slice(outer, F.lit(1), F.greatest(n, F.lit(0)))
    vertices = F.concat(F.transform(base, lambda p: corner(p, F.lit(0.0))), F.transform(base, lambda p: corner(p, height)))
    order = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    walls = F.transform(order, lambda k: F.array(F.array(k, F.pmod(k + 1, n), F.pmod(k + 1, n) + n, k + n)))
    shell = F.concat(F.array(F.array(F.reverse(order))), F.array(F.array(F.transform(order, lambda k: k + n))), walls)
    solid = F.struct(F.lit("Solid").alias("type"), F.lit("1.2").alias("lod"), F.array(shell).alias("boundaries"))
    built = F.create_map(fid, F.struct(F.lit("Building").alias("type"), attributes.alias("attributes"), F.array(solid).alias("geometry")))
    line = F.to_json(F.struct(F.lit("CityJSONFeature").alias("type"), fid.alias("id"), built.alias("CityObjects"), vertices.alias("vertices")))
    return F.when((n >= 3) & (height > 0), line)


def write_city_sequence(buildings: DataFrame, path: str, epsg: int, scale: float = 0.001) -> None:
    """Buildings (fid, geom, height) as CityJSON text sequences: one part file a task, each line a feature.

    The head line with the transform and the frame is a file of its own, to be
    put before the parts.
    """
    spark = buildings.sparkSession
    head = F.to_json(F.struct(F.lit("CityJSON").alias("type"), F.lit("2.0").alias("version"), F.struct(F.array(*[F.lit(scale)] * 3).alias("scale"), F.array(*[F.lit(0.0)] * 3).alias("translate")).alias("transform"), F.struct(F.lit(f"https://www.opengis.net/def/crs/EPSG/0/{epsg}").alias("referenceSystem")).alias("metadata"), F.create_map().cast("map<string,string>").alias("CityObjects"), F.array().cast("array<array<bigint>>").alias("vertices")))
    spark.range(1).select(head.alias("value")).write.mode("overwrite").text(f"{path}/head")
    others = [c for c in buildings.columns if c not in ("fid", "geom")]
    told = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(None).alias("none"))
    line = city_feature(F.col("fid").cast("string"), F.get("geom.rings", F.lit(0)), F.col("height"), told, scale)
    buildings.select(line.alias("value")).where("value IS NOT NULL").write.mode("overwrite").text(f"{path}/features")


def svg_sketch(ring: Column, width: float = 400.0) -> Column:
    """An SVG drawing of a ring to fit a width; null without points."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    x0, y1 = F.array_min(xs), F.array_max(ys)
    scale = width / F.greatest(F.array_max(xs) - x0, y1 - F.array_min(ys), F.lit(1e-9))
    points = F.array_join(F.transform(ring, lambda p: F.format_string("%.1f,%.1f", (p["x"] - x0) * scale, (y1 - p["y"]) * scale)), " ")
    return F.when(F.size(ring) > 0, F.format_string(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:.0f} {width:.0f}"><polygon points="%s" fill="none" stroke="black"/></svg>', points))


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def kml_placemark(name: Column, lon: Column, lat: Column, height: Column) -> Column:
    """A KML placemark of a point above the ground; null without a place."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.format_string("<Placemark><name>%s</name><Point><altitudeMode>relativeToGround</altitudeMode><coordinates>%.7f,%.7f,%.1f</coordinates></Point></Placemark>", _escaped(F.coalesce(name, F.lit(""))), lon, lat, F.coalesce(height, F.lit(0.0))))


def sketch_xml(fid: Column, sketch: Column) -> Column:
    """A field sketch (base_line and stations) as XML."""
    rows = F.transform(sketch["stations"], lambda s: F.format_string('<station n="%d" chainage="%.2f" offset="%.2f" side="%s"/>', s["nth"], s["chainage"], s["offset"], s["side"]))
    return F.when(sketch.isNotNull(), F.format_string('<sketch id="%s" base="%.2f">%s</sketch>', _escaped(fid.cast("string")), sketch["base_line"], F.array_join(rows, "")))
