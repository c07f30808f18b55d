"""Normal forms of attribute values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that state nothing, words for yes and no, and area units in square metres.
PLACEHOLDERS = ["", "-", "--", "?", "na", "n/a", "nil", "none", "null", "not known", "-1", "-1.0"]
TRUE_WORDS = ["1", "1.0", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "0.0", "f", "false", "n", "no"]
AREA_UNITS = {
    "": 1.0, "m2": 1.0, "sqm": 1.0, "sqmt": 1.0, "sqmtr": 1.0, "sqmetre": 1.0, "sqmetres": 1.0, "squaremetres": 1.0,
    "ha": 10000.0, "hectare": 10000.0, "hectares": 10000.0, "are": 100.0, "ares": 100.0, "km2": 1e6, "sqkm": 1e6,
    "acre": 4046.8564224, "acres": 4046.8564224, "ac": 4046.8564224, "cent": 40.468564224, "cents": 40.468564224,
    "sqft": 0.09290304, "ft2": 0.09290304, "ground": 222.967296, "grounds": 222.967296,
}
INDIC_DIGITS = "௦௧௨௩௪௫௬௭௮௯०१२३४५६७८९"
ROMAN_STEPS = [("iv", 4), ("ix", 9), ("xl", 40), ("xc", 90), ("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100)]

_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]+"
_JOINT = r"[/\\.\-\u2010-\u2015\u2212_\s]+"


def squeezed(text: Column) -> Column:
    """Text without outer space, inner runs of space as one blank."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def stated(clean: Column, number: Column) -> Column:
    """What a statement says as text, null where it says nothing.

    The squeezed text counts if it is no placeholder, else the number; -1 and
    NaN state nothing.
    """
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    shown = F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    return F.coalesce(F.when(~F.lower(clean).isin(PLACEHOLDERS), clean), F.when((number != -1) & ~F.isnan(number), shown))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, INDIC_DIGITS, "01234567890123456789")


def dense_identifier(low: Column) -> Column:
    """Parts of an identifier joined by single slashes, in upper case, without a leading label."""
    joined = F.regexp_replace(F.regexp_replace(F.upper(low), _JOINT, "/"), r"^(?:(?:SURVEY|SY|S|TS|RS)/?(?:NO|NUMBER)?/)?/*0*(?=\d)", "")
    return F.regexp_replace(F.regexp_replace(joined, r"/+$", ""), r"(?<=\d)/(?=[A-Z])", "")


def survey_number(dense: Column) -> Column:
    """A dense identifier if it is a survey number NNN or NNN/SUB, else null."""
    return F.when(dense.rlike(r"^\d+[A-Z]{0,3}(?:/[0-9]+[A-Z]*)*\z"), dense)


def survey_normal_form(text: Column) -> Column:
    """Normal form of a survey number; null where there is none.

    437, `437 / 2 A`, 0437-2A, 437.2A and Tamil digits give 437, 437/2A,
    437/2A, 437/2A and plain digits.
    """
    return survey_number(dense_identifier(ascii_digits(text)))


def roman(text: Column) -> Column:
    """Value of a roman numeral of lower-case letters up to c."""
    unary = text
    for letters, value in ROMAN_STEPS:
        unary = F.replace(unary, F.lit(letters), F.lit("#" * value))
    return F.length(unary).cast("bigint")


def number_token(low: Column) -> Column:
    """The digits or the roman numeral of a text with words around it, else an empty text."""
    return F.regexp_extract(low, r"^(?:[a-z][a-z .]*[ .-]\s*|[a-z]+(?=\d))?(\d{1,15}|[ivxlc]+(?=\s|\z))(?:\.0*)?(?:\s*[a-z][a-z .]*)?\z", 1)


def whole_number(token: Column) -> Column:
    return F.when(token.rlike(r"^\d+\z"), token.cast("bigint")).when(token != "", roman(token))


def amount_token(low: Column) -> Column:
    """`number unit` of an amount: thousands separators gone, unit without blanks and dots."""
    flat = F.regexp_replace(F.regexp_replace(low, r"(?<=\d),(?=\d)", ""), "\u00b2", "2")
    return F.regexp_replace(F.regexp_replace(flat, r"^(\d+(?:\.\d+)?|\.\d+)\s*", "$1#"), r"[ ]|\.(?!\d)", "")


def area_m2(token: Column) -> Column:
    """An area in square metres; a bare number is taken as such, an unknown unit gives null."""
    by_size: dict[float, list[str]] = {}
    for unit, size in AREA_UNITS.items():
        by_size.setdefault(size, []).append(unit)
    unit, factor = F.substring_index(token, "#", -1), F
    for size, units in by_size.items():
        factor = factor.when(unit.isin(units), F.lit(size))
    return F.try_multiply(F.substring_index(token, "#", 1).try_cast("double"), factor)


def truth(low: Column) -> Column:
    return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False)


def bare_key(text: Column) -> Column:
    """Letters and digits only, lower case: `Extent M2`, extentM2 and extent-m2 are one."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def code_digits(text: Column) -> Column:
    """An administrative code as its digits."""
    return F.nullif(F.regexp_extract(text, r"^(\d+)(?:\.0+)?\z", 1), F.lit(""))
