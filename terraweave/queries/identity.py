"""Identifiers, names and places of the land records, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraweave.functions import identifiers as I
from terraweave.functions import names as N
from terraweave.operators.serving import minted_codes
from terraweave.session import durable, table

_PLACE_KEYS = ["village", "Village", "locality", "area_name", "name", "Taluk", "taluk", "District", "region_name", "road_name"]
_LON = "80.0 + CAST(p_partkey % 997 AS DOUBLE) / 100"
_LAT = "8.0 + CAST(p_partkey % 491 AS DOUBLE) / 100"


def _property(spark, sf_dir, *keys):
    """(key, value) of the properties under some keys, each pair once."""
    f = table(spark, sf_dir, "source_feature").select(F.explode("properties").alias("key", "value"))
    return f.where(F.col("key").isin(*keys) & F.col("value").isNotNull()).distinct()


def _places(spark, sf_dir):
    return _property(spark, sf_dir, *_PLACE_KEYS).select("value").distinct()


def _words(spark, sf_dir):
    """The different words of all documents that have a sign beyond Latin."""
    d = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\s\x21-\x40]+")).alias("word"))
    return d.where(F.col("word").rlike("[ऀ-෿]")).distinct()


def f3_forms(spark, sf_dir):
    """Normal forms of wards, zones and codes as the sources spell them."""
    p = _property(spark, sf_dir, "ward_no", "ward_number", "ward", "zone_number", "zone", "zone_no", "lgd_village_code", "lgd_taluk_code")
    return p.select("key", "value", I.ward_form(F.col("value")).alias("ward"), I.zone_form(F.col("value")).alias("zone"), I.door_form(F.col("value")).alias("door"), I.lgd_form(F.col("value")).alias("lgd"))


def f4_scripts(spark, sf_dir):
    """The main script of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", N.script(F.col("text")).alias("script"))


def f5_transliterated(spark, sf_dir):
    """Every Indic word of the documents in Latin letters."""
    return _words(spark, sf_dir).select("word", N.transliterated(F.col("word")).alias("latin"))


def f6_folded(spark, sf_dir):
    """The phonetic skeleton of every word of a place's name."""
    w = _places(spark, sf_dir).select(F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    return w.select("word", N.folded(F.col("word")).alias("folded"))


def f7_names(spark, sf_dir):
    """Normal forms of all place names, as names and as places."""
    n = _places(spark, sf_dir).select("value", N.normal_name(F.col("value")).alias("n"), N.normal_place(F.col("value")).alias("place"))
    return n.select("value", F.col("n.key").alias("key"), F.col("n.initials").alias("initials"), F.size("n.tokens").cast("bigint").alias("tokens"), "place")


def f8_blend(spark, sf_dir):
    """Similarity of every two place names that begin alike."""
    n = durable(_places(spark, sf_dir).select("value", N.normal_name(F.col("value")).alias("n")).withColumn("k", F.substring(F.lower("value"), 1, 2)))
    a, b = n.select("k", F.col("value").alias("a"), F.col("n").alias("na")), n.select("k", F.col("value").alias("b"), F.col("n").alias("nb"))
    return a.join(b, "k").where("a < b").select("a", "b", F.round(N.name_similarity(F.col("na"), F.col("nb")), 3).alias("similarity"))


def f9_places(spark, sf_dir):
    """The canonical form of all place names."""
    return _places(spark, sf_dir).select("value", N.canonical_place(F.col("value")).alias("place"))


def f11_check_characters(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.concat(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.regexp_replace("p_brand", "[^0-9A-Za-z]", ""))).alias("body"))
    return p.select("p_partkey", F.concat("body", I.check_character(F.col("body"))).alias("code"))


def f12_geohash(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_LON} AS lon", f"{_LAT} AS lat")
    return p.select("p_partkey", I.geohash(F.col("lon"), F.col("lat"), 8).alias("hash"))


def f16_short(spark, sf_dir):
    """Texts of documents cut to 120 signs with their length, and the vintage of their dates."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", I.short_text(F.col("text")).alias("short"), I.vintage(F.col("received_at").cast("string")).alias("vintage"))


def f17_lists(spark, sf_dir):
    """Datasets by how many lineage parents they state, through a comma-joined text."""
    d = table(spark, sf_dir, "source_dataset").select("dataset_id", F.array_join(F.coalesce("lineage_parents", F.array().cast("array<string>")), ",").alias("joined"))
    return d.select("dataset_id", F.explode_outer(I.listed(F.col("joined"))).alias("parent"))


def l1_codes(spark, sf_dir):
    """A code for every cadastral feature from ward, village and cell, told apart by a nonce where cells are shared."""
    from terraweave.operators.overlay import ground_polygons
    from terraweave.functions.crs import add_lonlat

    p = ground_polygons(table(spark, sf_dir, "source_feature"), ["parcel"]).select("fid", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.coalesce(F.col("properties")["lgd_village_code"], F.lit("0")).alias("village"))
    located = add_lonlat(p, "x", "y", "lon", "lat")
    rows = located.select("fid", F.lit("33").alias("state"), F.lit("GCC").alias("body"), F.concat_ws("/", F.lit("33"), F.lit("571"), F.lit("GCC"), "village", F.lit("")).alias("key"), I.geohash(F.col("lon"), F.col("lat"), 7).alias("cell"))
    codes = minted_codes(rows)
    return codes.groupBy("nonce").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("codes"), F.count_if(I.valid_code(I.grouped_code(F.col("code")))).alias("valid"))


QUERIES = {
    "f3_forms": f3_forms, "f4_scripts": f4_scripts, "f5_transliterated": f5_transliterated, "f6_folded": f6_folded, "f7_names": f7_names, "f8_blend": f8_blend, "f9_places": f9_places,
    "f11_check_characters": f11_check_characters, "f12_geohash": f12_geohash, "f16_short": f16_short, "f17_lists": f17_lists, "l1_codes": l1_codes,
}

_KEYS = ", ".join(f"'{k}'" for k in _PLACE_KEYS)
_PLACES = f"p AS (SELECT DISTINCT kv.value AS value FROM (SELECT unnest(map_entries(properties)) AS kv FROM source_feature) WHERE kv.key IN ({_KEYS}) AND kv.value IS NOT NULL)"


def _folded_sql(word: str) -> str:
    out = f"lower({word})"
    for pattern, sound in N.SOUNDS:
        out = f"regexp_replace({out}, '{pattern}', '{sound}', 'g')" if "\\1" not in pattern else _undoubled(out)
    out = f"regexp_replace({out}, '[^a-z]', '', 'g')"
    return f"list_transform([{out}], lambda o: CASE WHEN length(o) > 4 THEN o[1] || regexp_replace(o[2:], '[aeiou]', '', 'g') ELSE o END)[1]"


def _undoubled(text: str) -> str:
    """Runs of one consonant as one: RE2 has no back references, so sign by sign."""
    return f"list_transform([{text}], lambda t: array_to_string(list_filter(string_split(t, ''), lambda c, i: i = 1 OR c <> t[i - 1] OR c NOT IN ('b','c','d','f','g','h','k','l','m','n','p','r','s','t','v')), ''))[1]"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _script_sql(text: str) -> str:
    rows = ", ".join(f"struct_pack(n := length({text}) - length(regexp_replace({text}, '[{chr(a)}-{chr(b)}]', '', 'g')), at := -(strpos({text}, nullif(regexp_extract({text}, '[{chr(a)}-{chr(b)}]'), ''))), name := '{k}')" for k, (a, b) in N.SCRIPTS.items())
    return f"list_transform([list_sort([{rows}], 'DESC', 'NULLS LAST')[1]], lambda s: CASE WHEN s.n > 0 THEN s.name END)[1]"


def _latin_sql(text: str) -> str:
    cases = " ".join(f"WHEN {(N.SCRIPTS[k][0] >> 7)} THEN [{', '.join('NULL' if i not in {**N.INDIC, **own} else repr({**N.INDIC, **own}[i]) for i in range(128))}]" for k, own in N.INDIC_OWN.items())
    blocks = " ".join(f"WHEN '{k}' THEN {N.SCRIPTS[k][0] >> 7}" for k in N.INDIC_OWN)
    return f"""SELECT {text} AS word, CASE WHEN b IS NULL THEN {text} ELSE regexp_replace(regexp_replace(array_to_string(list_transform(string_split(w, ''), lambda c: CASE WHEN unicode(c) // 128 = b THEN coalesce(tbl[unicode(c) % 128 + 1], c) ELSE c END), ''), 'a+([eiou])', '\\1', 'g'), 'aa+', 'a', 'g') END AS latin
FROM (SELECT *, CASE b {cases} END AS tbl, CASE WHEN b = 23 THEN replace(replace({text}, 'க்ஷ', 'ksha'), 'ஸ்ரீ', 'sri') ELSE {text} END AS w FROM (SELECT *, CASE s {blocks} END AS b FROM (SELECT {text}, {_script_sql(text)} AS s FROM words)))"""


_FOLDED_NAMES = f"""n AS (SELECT value, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(trim(value)), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s@./-]', ' ', 'g'), '[./-]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN {_in(N.HONORIFICS + N.RELATIONS)}) AS words FROM p),
t AS (SELECT value, list_sort(list_distinct(list_filter(list_transform(list_filter(words, lambda w: NOT (length(w) = 1 AND regexp_full_match(w, '\\p{{L}}'))), lambda w: {_folded_sql('w')}), lambda w: w <> ''))) AS tokens, array_to_string(list_sort(list_filter(words, lambda w: length(w) = 1 AND regexp_full_match(w, '\\p{{L}}'))), '') AS initials FROM n)"""
_PLACE_FORM = "array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower({v}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN " + _in(N.PLACE_WORDS) + "), lambda w: " + _folded_sql("w").replace("{", "{{").replace("}", "}}") + "), lambda w: w <> ''), ' ')"
_FORMER = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in N.FORMER_NAMES.items()) + "}"
_ROMANS = "['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV', 'XVI', 'XVII', 'XVIII', 'XIX', 'XX', 'XXI', 'XXII', 'XXIII', 'XXIV', 'XXV', 'XXVI', 'XXVII', 'XXVIII', 'XXIX', 'XXX']"

ORACLES = {
    "f3_forms": f"""WITH p AS (SELECT DISTINCT kv.key AS key, kv.value AS value FROM (SELECT unnest(map_entries(properties)) AS kv FROM source_feature) WHERE kv.key IN ('ward_no', 'ward_number', 'ward', 'zone_number', 'zone', 'zone_no', 'lgd_village_code', 'lgd_taluk_code') AND kv.value IS NOT NULL),
f AS (SELECT *, ltrim(upper(regexp_replace(value, '[^0-9A-Za-z]', '', 'g')), '0') AS w, regexp_replace(upper(trim(value)), '\\D', '', 'g') AS d FROM p)
SELECT key, value, CASE WHEN value = '' THEN '' WHEN w = '' THEN '0' ELSE w END AS ward,
  CASE WHEN value = '' THEN '' WHEN list_contains({_ROMANS}, upper(trim(value))) THEN list_position({_ROMANS}, upper(trim(value)))::VARCHAR WHEN ltrim(d, '0') <> '' THEN ltrim(d, '0') WHEN d <> '' THEN '0' ELSE upper(trim(value)) END AS zone,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(value)), '\\s+', '', 'g'), '[,\\\\]', '/', 'g'), '(?:NO|D\\.?NO|DOOR)\\.?', '', 'g'), '[-–—]', '/', 'g'), '/+', '/', 'g'), '/') AS door,
  CASE WHEN value = '' THEN '' WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END AS lgd FROM f""",
    "f4_scripts": f"SELECT doc_id, {_script_sql('text')} AS script FROM documents",
    "f5_transliterated": "WITH words AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '[\\s\\x21-\\x40]+')) AS word FROM documents) WHERE regexp_matches(word, '[ऀ-෿]')) " + _latin_sql("word"),
    "f6_folded": f"WITH {_PLACES}, w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(value), '[^a-z]+')) AS word FROM p) WHERE word <> '') SELECT word, {_folded_sql('word')} AS folded FROM w",
    "f7_names": f"WITH {_PLACES}, {_FOLDED_NAMES} SELECT value, array_to_string(tokens, '') AS key, initials, len(tokens) AS tokens, {_PLACE_FORM.format(v='value')} AS place FROM t",
    "f8_blend": f"""WITH {_PLACES}, {_FOLDED_NAMES}, q AS (SELECT *, array_to_string(tokens, '') AS key, substr(lower(value), 1, 2) AS k FROM t)
SELECT a.value AS a, b.value AS b, CASE WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN 0 ELSE round(round(0.32 * len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)) + 0.34 * jaro_winkler_similarity(a.key, b.key)
  + 0.24 * list_max(flatten(list_transform(a.tokens, lambda x: list_transform(b.tokens, lambda y: jaro_winkler_similarity(x, y))))) + 0.10 * CASE WHEN a.initials <> '' AND a.initials = b.initials THEN 1 WHEN a.initials <> '' AND b.initials <> '' AND (contains(a.initials, b.initials) OR contains(b.initials, a.initials)) THEN 0.5 ELSE 0 END, 4), 3) END AS similarity
FROM q AS a JOIN q AS b ON a.k = b.k AND a.value < b.value""",
    "f9_places": f"""WITH {_PLACES}, c AS (SELECT value, trim(regexp_replace(lower(value), '[^a-z ]', ' ', 'g')) AS plain, {_FORMER} AS m FROM p),
d AS (SELECT value, coalesce(m[list_filter([plain] || regexp_split_to_array(plain, '\\s+'), lambda w: map_contains(m, w))[1]], value) AS now_ FROM c) SELECT value, {_PLACE_FORM.format(v='now_')} AS place FROM d""",
    "f11_check_characters": f"""
WITH b AS (SELECT p_partkey, upper(lpad(p_partkey::VARCHAR, 8, '0') || regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g')) AS body FROM part)
SELECT p_partkey, body || substr('{I.CHECK32}', 1 + list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(body) + 1), lambda k: greatest(strpos('{I.CHECK32}', body[k]) - 1, 0)::BIGINT * (2 * ((k - 1) % 8) + 1))), lambda s, v: (s * 3 + v) % 32)::INT, 1) AS code FROM b""",
    "f12_geohash": f"""WITH p AS (SELECT p_partkey, {_LON} AS lon, {_LAT} AS lat FROM part),
c AS (SELECT p_partkey, greatest(ceil((lon + 180) / 360 * 1048576)::BIGINT - 1, 0) AS x, greatest(ceil((lat + 90) / 180 * 1048576)::BIGINT - 1, 0) AS y FROM p)
SELECT p_partkey, array_to_string(list_transform(range(8), lambda k: substr('{I.BASE32}', 1 + list_sum(list_transform(range(5), lambda b: ((CASE WHEN (5 * k + b) % 2 = 0 THEN x ELSE y END) >> (19 - (5 * k + b) // 2)) % 2 * (1 << (4 - b))))::INT, 1)), '') AS hash FROM c""",
    "f16_short": "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 120) || '...[' || length(text) || ' chars]' END AS short, make_date(year(received_at), 6, 30) AS vintage FROM documents",
    "f17_lists": "SELECT dataset_id, unnest(CASE WHEN len(list_filter(coalesce(lineage_parents, []), lambda d: d <> '')) = 0 THEN [NULL] ELSE list_filter(lineage_parents, lambda d: d <> '') END) AS parent FROM source_dataset",
}
