"""Identifiers: check characters, geohash, wards, floors, survey siblings, names, as columns."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# The alphabets of geohashes and of identifiers (Crockford's base 32).
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
CHECK32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def check_character(body: Column) -> Column:
    """Check sign of an identifier: each step multiplies by 3 and adds the sign's value by an odd weight of 1 to 15, modulo 32.

    Three and all weights are odd, so every single substitution shows.  Signs
    that are not in the alphabet count 0.
    """
    signs = F.filter(F.split(body, ""), lambda c: c != "")
    total = F.aggregate(
        F.transform(signs, lambda c, i: F.greatest(F.instr(F.lit(CHECK32), c) - 1, F.lit(0)) * (F.pmod(i, F.lit(8)) * 2 + 1)), F.lit(0), lambda s, v: F.pmod(s * 3 + v, F.lit(32))
    )
    return F.substring(F.lit(CHECK32), total + 1, F.lit(1))


def base32_number(n: Column, width: int) -> Column:
    """A number as ``width`` base-32 signs."""
    return F.concat(*[F.substring(F.lit(CHECK32), (F.pmod(F.shiftright(n, 5 * k), F.lit(32)) + 1).cast("int"), F.lit(1)) for k in range(width - 1, -1, -1)])


def geohash(lon: Column, lat: Column, precision: int = 8) -> Column:
    """Geohash by scaling and interleaving bits, without a loop over the bits at run time; a border belongs to the lower cell."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    cell = lambda v, lo, span, n: F.greatest(F.lit(0), F.least(F.ceil((v - lo) / span * (1 << n)) - 1, F.lit((1 << n) - 1))).cast("bigint")
    x, y = cell(lon, -180.0, 360.0, nx), cell(lat, -90.0, 180.0, ny)
    signs = []
    for k in range(precision):
        value = F.lit(0).cast("bigint")
        for b in range(5):
            bit = 5 * k + b
            source, n = (x, nx) if bit % 2 == 0 else (y, ny)
            value = value * 2 + F.pmod(F.shiftright(source, n - 1 - bit // 2), F.lit(2))
        signs.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*signs)


@F.pandas_udf(LongType())
def blake_number(text: pd.Series) -> pd.Series:
    """The eight-byte BLAKE2b digest of a text modulo 2 to the 40; no engine has it built in."""
    number = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % (1 << 40)
    return pd.Series([None if t is None else number(t) for t in text], dtype="Int64")


@F.pandas_udf(StringType())
def blake_hex(text: pd.Series) -> pd.Series:
    """The twelve-byte BLAKE2b digest of a text in hexadecimal signs."""
    return pd.Series([None if t is None else hashlib.blake2b(t.encode(), digest_size=12).hexdigest() for t in text])


def entity_id(prefix: Column, area: Column, feature_class: Column, wkt: Column) -> Column:
    """Identifier of an entity from its area of interest, class and geometry text."""
    return F.concat(prefix, F.lit("-"), blake_hex(F.concat_ws("|", area, feature_class, wkt)))


def parcel_code(state: Column, body: Column, key: Column, cell: Column, nonce: Column) -> Column:
    """Fourteen signs: two of the state, three of the local body, eight of the hashed key, cell and nonce (none for 0), a check sign."""
    plain = lambda c: F.regexp_replace(F.upper(c), "[^0-9A-Z]", "")
    seed = F.concat(key, F.lit("|"), cell, F.when(nonce > 0, F.concat(F.lit("|"), nonce.cast("string"))).otherwise(F.lit("")))
    payload = F.concat(F.substring(F.lpad(plain(state), 2, "0"), 1, 2), F.substring(F.rpad(plain(body), 3, "0"), 1, 3), base32_number(blake_number(seed), 8))
    return F.concat(payload, check_character(payload))


def valid_code(code: Column) -> Column:
    """Whether a parcel code has fourteen signs of the alphabet and the right check sign; grouping signs are ignored."""
    plain = F.regexp_replace(F.upper(F.trim(code)), "-", "")
    return F.coalesce(plain.rlike(f"^[{CHECK32}]{{14}}$") & (check_character(F.substring(plain, 1, 13)) == F.substring(plain, 14, 1)), F.lit(False))


def grouped_code(code: Column) -> Column:
    """A parcel code as it is printed: 2-3-4-4-1."""
    up = F.upper(code)
    return F.concat_ws("-", F.substring(up, 1, 2), F.substring(up, 3, 3), F.substring(up, 6, 4), F.substring(up, 10, 4), F.substring(up, 14, 1))


def ward(text: Column) -> Column:
    """Ward number without words and leading zeros."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(\d+)", 1), r"^0+(?=\d)", ""), F.lit(""))


def ward_form(text: Column) -> Column:
    """Normal form of a ward: letters and digits in capitals without leading zeros; 0 for zeros only, empty for nothing."""
    flat = F.ltrim(F.upper(F.regexp_replace(text, "[^0-9A-Za-z]", "")), F.lit("0"))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(flat == "", "0").otherwise(flat)


def zone_form(text: Column) -> Column:
    """Normal form of a zone: a Roman numeral as a number, else the digits without leading zeros, else the text in capitals."""
    up = F.upper(F.trim(text))
    value = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv]), c)
    signs = F.reverse(F.filter(F.split(up, ""), lambda c: c != ""))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    read = F.aggregate(signs, zero, lambda s, c: F.struct((s["total"] + F.when(value(c) < s["most"], -value(c)).otherwise(value(c))).alias("total"), F.greatest(s["most"], value(c)).alias("most")))
    digits = F.regexp_replace(up, r"\D", "")
    short = F.ltrim(digits, F.lit("0"))
    number = F.when(up.rlike("^[IVXLCDM]+$"), read["total"].cast("string"))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.coalesce(number, F.when(short != "", short).when(digits != "", "0").otherwise(up)))


# Roman numerals.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def door_form(text: Column) -> Column:
    """Normal form of a door number: capitals, no blanks and no word for number, one slash between parts."""
    flat = F.regexp_replace(F.upper(F.trim(text)), r"\s+", "")
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, r"[,\\]", "/"), r"(?:NO|D\.?NO|DOOR)\.?", ""), "[-–—]", "/")
    return F.coalesce(F.trim(F.regexp_replace(flat, "/{2,}", "/"), F.lit("/")), F.lit(""))


def lgd_form(text: Column) -> Column:
    """Digits of a directory code without leading zeros; 0 where there are none, empty for nothing."""
    digits = F.ltrim(F.regexp_replace(text, r"\D", ""), F.lit("0"))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(digits == "", "0").otherwise(digits)


def floors(text: Column) -> Column:
    """Storeys of `3`, `G+2`, `B+G+5`, `G2`: the ground floor counts one, a basement none."""
    flat = F.upper(F.regexp_replace(text, r"\s+", ""))
    plain = F.regexp_extract(flat, r"^(\d+)$", 1)
    ground = F.regexp_extract(flat, r"^(?:B\d*\+)?G\+?(\d*)$", 1)
    return F.when(plain != "", plain.cast("bigint")).when(flat.rlike(r"^(?:B\d*\+)?G\+?\d*$"), F.coalesce(F.nullif(ground, F.lit("")).cast("bigint"), F.lit(0)) + 1)


def parent_number(number: Column) -> Column:
    return F.substring_index(number, "/", 1)


def siblings(a: Column, b: Column) -> Column:
    """Different subdivisions of one parent number."""
    return (parent_number(a) == parent_number(b)) & (a != b) & F.contains(a, F.lit("/")) & F.contains(b, F.lit("/"))


def fingerprint(*parts: Column) -> Column:
    """Sixteen hexadecimal signs of the SHA-256 of the parts, nulls told from empty texts."""
    told = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *told), 256), 1, 16)


def descends(a: Column, b: Column) -> Column:
    """Whether number ``a`` is a subdivision of ``b``: the same parts and more."""
    one, two = F.split(a, "/"), F.split(b, "/")
    return (F.size(one) > F.size(two)) & (F.slice(one, F.lit(1), F.size(two)) == two)


def short_text(text: Column, limit: int = 120) -> Column:
    """A text, cut at a length and marked with the length it had."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...["), F.length(text).cast("string"), F.lit(" chars]")))


def vintage(text: Column) -> Column:
    """The 30th of June of the year a text begins with; null without one."""
    return F.try_to_date(F.concat(F.nullif(F.regexp_extract(text, r"^(\d{4})", 1), F.lit("")), F.lit("-06-30")), "yyyy-MM-dd")


def listed(text: Column) -> Column:
    """The entries of a comma-joined text, empty ones left out."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda d: d != "")


def tile(lon: Column, lat: Column, zoom: int) -> Column:
    """Tile column and row of a web map at a zoom."""
    n = float(1 << zoom)
    phi = F.radians(lat)
    return F.struct(F.floor((lon + 180) / 360 * n).alias("x"), F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / 3.141592653589793) / 2 * n).alias("y"))
