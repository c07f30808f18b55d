from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from terraweave.operators import quantiles as Q


def test_quantiles_equal_numpy(spark, monkeypatch):
    rng = random.Random(1)
    for n in (1, 2, 3, 10, 999, 5000):
        values = [rng.choice([rng.gauss(0, 1), 0.5, 7.0]) for _ in range(n)]
        df = spark.createDataFrame([(v, -v) for v in values] + [(None, None)], "v double, w double").repartition(4)
        row = Q.exact_quantiles(df, m=("v", 0.5), p=("v", 0.95), o=("w", 0.1), lo=("v", 0.0), hi=("v", 1.0)).first()
        want = [np.quantile(values, 0.5), np.quantile(values, 0.95), np.quantile([-v for v in values], 0.1), min(values), max(values)]
        assert np.allclose([row.m, row.p, row.o, row.lo, row.hi], want)
    # A coarse sketch has wider brackets, not other results.
    monkeypatch.setattr(Q, "ACCURACY", 100)
    assert abs(Q.exact_quantiles(df, m=("v", 0.37)).first().m - np.quantile(values, 0.37)) < 1e-12
    none = Q.exact_quantiles(df.where(F.lit(False)), m=("v", 0.5)).collect()
    assert len(none) == 1 and none[0].m is None
