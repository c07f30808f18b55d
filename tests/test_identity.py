from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from terraweave.functions import identifiers as I
from terraweave.functions import names as N
from terraweave.operators.serving import minted_codes


def test_every_single_substitution_shows(spark):
    body = "33GCC4F7K2M9Q"
    changed = [body[:i] + c + body[i + 1 :] for i in range(13) for c in I.CHECK32 if c != body[i]]
    assert len(changed) == 13 * 31
    df = spark.createDataFrame([(body,)] + [(c,) for c in changed], "t string")
    signs = [r[0] for r in df.select(I.check_character(F.col("t"))).collect()]
    assert signs[0] not in signs[1:]
    total = 0
    for i, c in enumerate(body):
        total = (total * 3 + I.CHECK32.index(c) * (2 * (i % 8) + 1)) % 32
    assert signs[0] == I.CHECK32[total]


def test_codes_are_unique_valid_and_stable(spark):
    rows = [(k, "33", "gcc", "33/571/GCC/1/2", f"tf33n{k % 7}") for k in range(60)]
    got = {r.fid: r for r in minted_codes(spark.createDataFrame(rows, "fid int, state string, body string, key string, cell string")).withColumn("ok", I.valid_code(I.grouped_code(F.col("code")))).collect()}
    assert len({r.code for r in got.values()}) == 60 and all(r.ok and len(r.code) == 14 for r in got.values())
    digest = int.from_bytes(hashlib.blake2b(b"33/571/GCC/1/2|tf33n0", digest_size=8).digest(), "big") % (1 << 40)
    assert got[0].nonce == 0 and got[7].nonce == 1 and got[0].code[5:13] == "".join(I.CHECK32[digest >> 5 * k & 31] for k in range(7, -1, -1))
    bad = spark.createDataFrame([(got[0].code[:-1] + "U",), (None,), ("",), ("12",)], "c string")
    assert [r[0] for r in bad.select(I.valid_code(F.col("c"))).collect()] == [False] * 4


def test_forms(spark):
    df = spark.createDataFrame([("IX", "12/A-3", "W 012", "0600.001"), ("09", "Door No. 7,,2", "000", "x"), ("9", None, None, None), ("", "", "", "")], "z string, d string, w string, l string")
    got = df.select(I.zone_form(F.col("z")), I.door_form(F.col("d")), I.ward_form(F.col("w")), I.lgd_form(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("9", "12/A/3", "W012", "600001"), ("9", "7/2", "0", "0"), ("9", "", "", ""), ("", "", "", "")]
    pairs = spark.createDataFrame([("437/2/A", "437/2"), ("437/2", "437/2"), ("438/2", "437"), ("437/2", "437")], "a string, b string")
    assert [r[0] for r in pairs.select(I.descends(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_names_of_one_person_and_of_others(spark):
    rows = [("Ramaswamy s/o Krishnan", "RAMASAMY KRISHNAN"), ("Thiru R. Muthuvel", "Muthuvel R"), ("Lakshmi Devi", "Laxmi Devi"), ("Ramaswamy", "Fatima Begum"), (None, "x"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(N.name_similarity(N.normal_name(F.col("a")), N.normal_name(F.col("b")))).collect()]
    assert min(got[:3]) > 0.6 and got[3] < 0.4 and got[4] == got[5] == 0.0
    places = spark.createDataFrame([("Madras",), ("Chennai",), ("Madras City",), ("சென்னை",), (None,)], "p string")
    a, b, c, *_ = [r[0] for r in places.select(N.canonical_place(F.col("p"))).collect()]
    assert a == b == c


def test_scripts_and_transliteration(spark):
    df = spark.createDataFrame([("கமலா க்ஷ",), ("कमला",), ("కమల",), ("plain",), ("42",), (None,)], "t string")
    got = [tuple(r) for r in df.select(N.script(F.col("t")), N.transliterated(F.col("t"))).collect()]
    assert got == [("tamil", "kamala ksha"), ("devanagari", "kamala"), ("telugu", "kamala"), ("latin", "plain"), (None, "42"), (None, None)]


def plain_jaro(a, b):
    if not a and not b:
        return 1.0
    reach, taken, hits = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
        if j is not None:
            taken.add(j)
            hits.append(c)
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(hits, sorted(taken))) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def test_many_jaro_winklers_equal_one_by_one():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    a, b = words[:150], words[150:]
    base = np.array([plain_jaro(x, y) for x, y in zip(a, b)])
    assert np.allclose(N.jaro_winkler_many(a, b, 0.0), base)
    boosted = N.jaro_winkler_many(a, b)
    assert (boosted >= base).all() and (boosted[base <= 0.7] == base[base <= 0.7]).all()
