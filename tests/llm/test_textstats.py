from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraweave.llm import textstats as X

COMMON = ["the", "of", "and", "to", "was", "in", "is", "a", "that", "it"]
PROSE = "The field surveyor was shown a gap between two sheets, and the owner of the plot said that it is old. "
DOCS = {
    1: PROSE * 3,
    2: "\n".join(f"- ward {k}" for k in range(12)),
    3: ", ".join(f"ward {k}" for k in range(20)),
    4: "id;x;y\n" + "\n".join(f"{k};{k}.5;{k * 7}" for k in range(12)),
    5: "\n".join('{"id": "%d", "x": "1.5", "use": "res"}' % k for k in range(8)),
    6: "buy land cheap plot villa premium loan corner seaside layout approved bargain " * 3,
    7: "^\x1b~□�□?�▒\x1b\x07" * 9,
    8: "<p>" + PROSE.upper() * 2 + "</p>",
    9: "1. " + PROSE + "\n2. " + PROSE,
    10: "tiny",
    11: None,
    12: "",
    13: " \n\t ",
    14: "W" * 90 + "jm2BBP6F7qbslaPZj+sM9Ug7Xsdzy1JErRfz4z4hoLYE1WRQaoEswZym5rXc4wWZ14",
    15: "id  x       y\n" + "\n".join(f"{k}       {k * 3}      {k * 11}" for k in range(100, 112)),
}
FORMS = {2: "list", 3: "list", 4: "table", 5: "table", 6: "junk", 7: "junk", 14: "junk", 15: "table"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "doc_id bigint, text string").withColumn("words", F.lit("clash"))


def test_forms(docs):
    got = {r.doc_id: r.form for r in X.found_forms(X.text_totals(docs, COMMON)).collect()}
    assert got == FORMS


def test_statistics(docs):
    rows = {r.doc_id: r for r in X.quality_statistics(X.text_totals(docs, COMMON)).collect()}
    assert len(rows) == len(DOCS)
    words = PROSE.replace(",", "").replace(".", "").lower().split()
    assert rows[1].words == 3 * len(words)
    assert abs(rows[1].mean_word_length - sum(map(len, words)) / len(words)) < 1e-9
    assert abs(rows[1].common_words - sum(w in COMMON for w in words) / len(words)) < 1e-9
    assert rows[1].punctuated_lines == 1 and rows[2].marked_lines == 1 and rows[11].words == 0 and rows[12].mean_word_length is None


def test_chunks_equal_the_whole(docs, monkeypatch):
    big = docs.select("doc_id", F.repeat(F.concat("text", F.lit("\n")), 9).alias("text"))
    whole = {r.doc_id: r for r in X.text_totals(big, COMMON).collect()}
    for size in (100, 333):
        cut = {r.doc_id: r for r in X.text_totals(big, COMMON, chunk=size).collect()}
        for k, row in whole.items():
            for name in ("chars", "letters", "digits", "words", "common", "word_letters", "lines"):
                assert row[name] == cut[k][name], (k, name)
        forms = {k: max(X.FORMS, key=lambda f: row[f"{f}_chars"]) for k, row in whole.items()}
        assert {k: max(X.FORMS, key=lambda f: row[f"{f}_chars"]) for k, row in cut.items()} == forms


def test_empty_table(docs):
    none = docs.limit(0)
    assert X.quality_statistics(X.text_totals(none, COMMON)).count() == 0


SIGNS = st.sampled_from([*"ab", "the", " ", "   ", "\t", "\n", ".", ",", "|", ":", '"', "-", "*", "7", "12", "~", "□", "க", "1. ", ")", "\r\n", "é"])


@settings(max_examples=400, deadline=None)
@given(st.lists(SIGNS, max_size=60).map("".join), st.integers(1, 9), st.integers(1, 4))
def test_any_cut_gives_the_counts_of_the_whole(text, chunk, fan):
    common, words = pa.array(COMMON), set(COMMON)
    data = np.frombuffer(text.encode(), np.uint8)
    whole = np.zeros(len(X.TOTALS))
    if len(data):
        m, _ = X.stretch_counts(data, np.zeros(1, np.int64), common)
        whole = X.totals_of(m, np.zeros(len(m), np.int64), 1)[0]
    edges = X._cuts(data, chunk)
    states = [X.chunk_state(data[a:b], common, 4) for a, b in zip(edges[:-1], edges[1:])] or [X.chunk_state(data, common, 4)]
    groups = [X.merged(states[k : k + fan], words, 4) for k in range(0, len(states), fan)]
    groups = [(*json.loads(json.dumps(g[:3])), g[3]) for g in groups]
    assert dict(zip(X.TOTALS, X.whole_totals(X.merged(groups, words, 4)))) == dict(zip(X.TOTALS, whole))


def test_one_long_line(spark, monkeypatch):
    monkeypatch.setattr(X, "FAN_IN", 3)
    lines = ["key: the value, of 12.   and~it's " * 6_000, "x" * 200_000, "a,b,,c;d|e\t" * 18_000, " " * 100_000 + "end of it.", "- the " + "word " * 40_000]
    docs = spark.createDataFrame(list(enumerate(lines)) + [(0, lines[0])], "doc_id bigint, text string")
    whole = sorted(map(tuple, X.text_totals(docs, COMMON, chunk=1 << 22).collect()))
    assert whole == sorted(map(tuple, X.text_totals(docs, COMMON).collect())) and len(whole) == 6
    assert [r[1] for r in whole] == [len(t.strip()) for t in [lines[0], *lines]]
