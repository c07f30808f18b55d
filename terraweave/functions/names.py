"""Names in several scripts: detection, transliteration, phonetic folding, normal forms and similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Titles, relation words, words that are no part of a place's name, and former names of places.
HONORIFICS = [
    "mr", "mrs", "ms", "miss", "shri", "sri", "smt", "srimathi", "srimati", "thiru", "thirumathi", "tmt", "selvi", "selvan", "dr", "prof", "er", "adv", "late", "m/s",
    "messrs", "sardar", "sardarni", "haji", "hajji", "syed", "sheikh", "mohd", "md", "kum", "kumari", "shrimati", "janab", "begum",
]
RELATIONS = ["s", "so", "son", "w", "wo", "wife", "d", "do", "daughter", "h", "ho", "husband", "f", "fo", "father", "alias", "urf", "@"]
PLACE_WORDS = [
    "village", "vill", "gram", "panchayat", "taluk", "taluka", "tehsil", "mandal", "district", "dist", "town", "city", "post", "po", "colony", "nagar", "puram", "pettai",
    "pakkam", "kuppam", "extn", "extension", "phase", "block", "sector", "ward", "zone", "north", "south", "east", "west", "new", "old",
]
FORMER_NAMES = {
    "madras": "chennai", "trichy": "tiruchirappalli", "trichinopoly": "tiruchirappalli", "tanjore": "thanjavur", "tuticorin": "thoothukudi", "conjeevaram": "kancheepuram",
    "ootacamund": "udhagamandalam", "ooty": "udhagamandalam", "vellore": "vellore", "cuddalore": "cuddalore", "coimbatore": "coimbatore", "bangalore": "bengaluru",
    "mysore": "mysuru", "calcutta": "kolkata", "bombay": "mumbai", "poona": "pune", "baroda": "vadodara", "cochin": "kochi", "trivandrum": "thiruvananthapuram",
    "pondicherry": "puducherry", "quilon": "kollam", "calicut": "kozhikode",
}
# Spellings of one sound, in the order in which they are replaced.
SOUNDS = [
    ("aa+", "a"), ("ee+", "i"), ("oo+", "u"), ("ii+", "i"), ("uu+", "u"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("gh", "g"), ("kh", "k"), ("ph", "f"), ("ch", "c"), ("sh", "s"),
    ("zh", "l"), ("z", "s"), ("w", "v"), ("y$", "i"), ("ck", "k"), ("x", "ks"), ("q", "k"), ("j", "g"), (r"([bcdfghklmnprstv])\1+", "$1"),
]
# First and last code point of each script.
SCRIPTS = {
    "devanagari": (0x0900, 0x097F), "bengali": (0x0980, 0x09FF), "gurmukhi": (0x0A00, 0x0A7F), "gujarati": (0x0A80, 0x0AFF), "oriya": (0x0B00, 0x0B7F), "tamil": (0x0B80, 0x0BFF),
    "telugu": (0x0C00, 0x0C7F), "kannada": (0x0C80, 0x0CFF), "malayalam": (0x0D00, 0x0D7F), "sinhala": (0x0D80, 0x0DFF), "arabic": (0x0600, 0x06FF), "latin": (0x0041, 0x024F),
}
# The Latin form of the letters and signs that the Indic blocks have at one offset.
INDIC = {
    0x02: "n", 0x03: "h", 0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "ri", 0x0E: "e", 0x0F: "ee", 0x10: "ai", 0x12: "o", 0x13: "oo", 0x14: "au",
    0x15: "ka", 0x16: "kha", 0x17: "ga", 0x18: "gha", 0x19: "nga", 0x1A: "cha", 0x1B: "chha", 0x1C: "ja", 0x1D: "jha", 0x1E: "nya", 0x1F: "ta", 0x20: "tha", 0x21: "da", 0x22: "dha",
    0x23: "na", 0x24: "ta", 0x25: "tha", 0x26: "da", 0x27: "dha", 0x28: "na", 0x29: "na", 0x2A: "pa", 0x2B: "pha", 0x2C: "ba", 0x2D: "bha", 0x2E: "ma", 0x2F: "ya", 0x30: "ra",
    0x31: "ra", 0x32: "la", 0x33: "la", 0x34: "zha", 0x35: "va", 0x36: "sha", 0x37: "sha", 0x38: "sa", 0x39: "ha", 0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu",
    0x43: "ri", 0x46: "e", 0x47: "ee", 0x48: "ai", 0x4A: "o", 0x4B: "oo", 0x4C: "au", 0x4D: "",
}
# Where a script differs, and conjuncts of several signs.
INDIC_OWN = {"devanagari": {0x0F: "e", 0x13: "o", 0x47: "e", 0x4B: "o"}, "tamil": {0x24: "tha"}, "telugu": {}, "kannada": {}, "malayalam": {0x02: "m", 0x24: "tha"}}
CONJUNCTS = {"க்ஷ": "ksha", "ஸ்ரீ": "sri"}


def script(text: Column) -> Column:
    """The script of most signs, of equals the one that comes first; null without any."""
    found = []
    for name, (low, high) in SCRIPTS.items():
        signs = f"[{chr(low)}-{chr(high)}]"
        found.append(F.struct(F.regexp_count(text, F.lit(signs)).alias("n"), F.negative(F.regexp_instr(text, F.lit(signs))).alias("at"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*found))
    return F.when(best["n"] > 0, best["name"])


def _letters(table: Column, block: int):
    """Signs of one block by its table of offsets; other signs stay."""
    return lambda c: F.when(F.shiftright(F.ascii(c), 7) == block, F.coalesce(F.nullif(F.get(table, F.ascii(c).bitwiseAND(127)), F.lit("?")), c)).otherwise(c)


def transliterated(text: Column, of: Column | None = None) -> Column:
    """Indic text in Latin letters by its main script (or ``of``); other scripts and signs stay.

    The blocks share one layout, so each script has one table by offset.  An a
    before another vowel goes.
    """
    kind = script(text) if of is None else of
    out = text
    for name, own in INDIC_OWN.items():
        row, base = {**INDIC, **own}, SCRIPTS[name][0] >> 7
        # One literal a script, so that expressions stay small: an entry for each offset, a question mark for none.
        table = F.split(F.lit("|".join(row.get(k, "?") for k in range(128))), "[|]")
        whole = text
        for conjunct, latin in CONJUNCTS.items() if name == "tamil" else ():
            whole = F.replace(whole, F.lit(conjunct), F.lit(latin))
        latin_of = _letters(table, base)
        out = F.when(kind == name, F.regexp_replace(F.array_join(F.transform(F.split(whole, ""), latin_of), ""), "a(?=[aeiou])", "")).otherwise(out)
    return out


def folded(name: Column) -> Column:
    """The phonetic skeleton of a Latin word: sounds spelled one way, letters only, inner vowels gone if it is long."""
    out = F.lower(name)
    for pattern, sound in SOUNDS:
        out = F.regexp_replace(out, pattern, sound)
    out = F.regexp_replace(out, "[^a-z]", "")
    return F.when(F.length(out) > 4, F.regexp_replace(out, "(?<=.)[aeiou]", "")).otherwise(out)


def normal_name(name: Column) -> Column:
    """STRUCT<tokens, key, initials> of a person's name: folded words in order, all of them as one, single letters in order.

    Titles and relation words go; a null name has no tokens.
    """
    latin = F.lower(transliterated(F.trim(F.coalesce(name, F.lit("")))))
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(latin, r"[^\p{L}\p{M}\p{N}_\s@./-]", " "), "[./-]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(*HONORIFICS, *RELATIONS))
    single = lambda w: (F.length(w) == 1) & w.rlike(r"^\p{L}$")
    tokens = F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(words, lambda w: ~single(w)), folded), lambda w: w != "")))
    return F.struct(tokens.alias("tokens"), F.array_join(tokens, "").alias("key"), F.array_join(F.array_sort(F.filter(words, single)), "").alias("initials"))


def normal_place(name: Column) -> Column:
    """Folded words of a place's name in their order, words for kinds of places left out."""
    words = F.split(F.regexp_replace(F.lower(transliterated(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+")
    kept = F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*PLACE_WORDS)), folded)
    return F.array_join(F.filter(kept, lambda w: w != ""), " ")


def canonical_place(name: Column) -> Column:
    """The normal form of the name a place has now; former names are looked up before anything is folded."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z ]", " "))
    now = F.create_map(*[F.lit(x) for kv in FORMER_NAMES.items() for x in kv])
    hits = F.filter(F.concat(F.array(plain), F.split(plain, r"\s+")), lambda w: F.map_contains_key(now, w))
    return normal_place(F.coalesce(F.element_at(now, F.get(hits, F.lit(0))), name))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), max(1, size.max(initial=0))), np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def jaro_winkler_many(left: list[str], right: list[str], weight: float = 0.1, least: float = 0.7) -> np.ndarray:
    """Jaro-Winkler similarity of many pairs at once, a position at a time for all of them."""
    if not left:
        return np.zeros(0)
    a, na = _codes(left)
    b, nb = _codes(right)
    rows = np.arange(len(left))
    reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
    columns = np.arange(b.shape[1])
    taken, hits = np.zeros(b.shape, bool), np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        can = (b == a[:, i : i + 1]) & ~taken & (columns < nb[:, None]) & (np.abs(columns - i) <= reach[:, None]) & (i < na)[:, None]
        hit = can.any(1)
        taken[rows[hit], can.argmax(1)[hit]] = True
        hits[:, i] = hit
    m = hits.sum(1)
    # What was matched, in its order on either side.
    order_a, order_b = np.argsort(~hits, axis=1, kind="stable"), np.argsort(~taken, axis=1, kind="stable")
    width = min(a.shape[1], b.shape[1])
    same = np.take_along_axis(a, order_a, 1)[:, :width] == np.take_along_axis(b, order_b, 1)[:, :width]
    swapped = ((~same) & (np.arange(width) < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(m > 0, (m / na + m / nb + (m - swapped) / m) / 3, 0.0)
    score = np.where((na == 0) & (nb == 0), 1.0, score)
    head = min(4, a.shape[1], b.shape[1])
    equal = (a[:, :head] == b[:, :head]) & (np.arange(head) < np.minimum(na, nb)[:, None])
    shared = np.cumprod(equal, axis=1).sum(1)
    return np.where(score > least, score + shared * weight * (1 - score), score)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity, null where a side is null; equal pairs of a batch are computed once."""
    pairs = pd.MultiIndex.from_arrays([a, b])
    code, unique = pd.factorize(pairs)
    keep = [k for k, (x, y) in enumerate(unique) if isinstance(x, str) and isinstance(y, str)]
    score = np.full(len(unique) + 1, np.nan)
    score[keep] = jaro_winkler_many([unique[k][0] for k in keep], [unique[k][1] for k in keep])
    found = score[code]
    return pd.Series(np.where(np.isnan(found), None, found), dtype="Float64").astype("float64")


@F.pandas_udf(DoubleType())
def best_token_pair(a: pd.Series, b: pd.Series) -> pd.Series:
    """The highest Jaro-Winkler similarity of a token of one list with a token of the other; 0 without any."""
    pairs = [(k, x, y) for k, (p, q) in enumerate(zip(a, b)) if p is not None and q is not None for x in p for y in q]
    out = np.zeros(len(a))
    if pairs:
        np.maximum.at(out, [k for k, _, _ in pairs], jaro_winkler_many([x for _, x, _ in pairs], [y for _, _, y in pairs]))
    return pd.Series(out)


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity 0..1 of two normal names: shared words, likeness of the keys and of the best pair of words, and initials."""
    none = (F.size(a["tokens"]) == 0) | (F.size(b["tokens"]) == 0)
    i, j = a["initials"], b["initials"]
    initials = F.when((i != "") & (i == j), 1.0).when((i != "") & (j != "") & (F.contains(i, j) | F.contains(j, i)), 0.5).otherwise(0.0)
    blend = 0.32 * token_overlap(a["tokens"], b["tokens"]) + 0.34 * jaro_winkler(a["key"], b["key"]) + 0.24 * best_token_pair(a["tokens"], b["tokens"]) + 0.10 * initials
    return F.when(none, 0.0).otherwise(F.round(blend, 4))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; null where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)
