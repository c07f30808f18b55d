from __future__ import annotations

import os

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraweave.llm import tokenizer as T

PATH = os.path.join(T.VOCABULARIES, T.BYTE_BPE_50K)
tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def split(ids, counts):
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


CASES = ["", " ", "it's we'll they've 'tis", "  a b\t c\n\n", "x's\"'re 's", "<|endoftext|>", "கிராம அலுவலர் 437/2A", "पड़ोसी ने", "aa" * 400, "\U0001f600\U0001f1ee ok²½", "ab" * 70_000 + " end", "   x​y"]


def test_equals_the_library(reference):
    ids, counts = T.encode_batch(pa.array([*CASES, None], pa.string()), PATH)
    assert split(ids, counts) == [reference.encode(t, add_special_tokens=False).ids for t in CASES] + [[]]


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.sampled_from("abs tredlvm'\"\n\t1.-é க்  ि"), max_size=50))
def test_random_texts_and_round_trip(reference, text):
    ids, _ = T.encode_batch(pa.array([text], pa.string()), PATH)
    assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids
    assert T._WORKERS[PATH].automaton.decode(ids) == text


def test_chunks_change_nothing(monkeypatch):
    texts = pa.array([" ".join(f"word{k} it's" for k in range(400)), "x" * 900, *CASES], pa.string())
    whole = T.encode_batch(texts, PATH)
    monkeypatch.setattr(T, "CHUNK_BYTES", 257)
    cut = T.encode_batch(texts, PATH)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_rows_stay(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x")], "doc_id bigint, text string").withColumn("ids", F.lit(5))
    got = sorted(((r.doc_id, r.ids) for r in T.token_ids(docs).collect()), key=str)
    assert got == sorted([(1, [64, 275]), (1, [64, 275]), (2, []), (3, []), (None, [87])], key=str)
    assert T.token_ids(docs.limit(0)).count() == 0
    assert sorted(r.tokens for r in T.token_counts(docs).collect()) == [0, 0, 1, 2, 2]
