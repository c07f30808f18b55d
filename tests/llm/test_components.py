from __future__ import annotations

import random

from pyspark.sql import functions as F

from terraweave.llm import components as C


def union_find(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, a in links:
        if r is not None and a is not None:
            parent[find(("r", r))] = find(("a", a))
    groups = {}
    for r, a in links:
        if r is not None and a is not None:
            groups.setdefault(find(("r", r)), set()).add(r)
    return {r: min(g) for g in groups.values() for r in g}


def run(spark, links):
    df = spark.createDataFrame(links, "record string, anchor string").withColumn("n", F.lit(1)).withColumn("b", F.lit("x"))
    return {r["record"]: r["group"] for r in C.consolidated(df).collect()}


def test_random_chains_and_a_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_LINKS", 5)
    monkeypatch.setattr(C, "HOT_SHARE", 20)
    rng = random.Random(3)
    links = [(f"r{rng.randrange(120):03}", f"e{rng.randrange(110)}") for _ in range(140)]
    links += [(f"h{k:02}", "hot") for k in range(40)] + [("h07", "e1"), ("r001", "e2")]
    links += [(f"c{k:02}", f"x{k}") for k in range(25)] + [(f"c{k + 1:02}", f"x{k}") for k in range(24)]
    links += links[:30] + [(None, "e1"), ("r000", None)]
    assert run(spark, links) == union_find(links)


def test_empty_and_alone(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", "1"), ("b", "2"), ("a", "1")]) == {"a": "a", "b": "b"}
