from __future__ import annotations

import datetime as dt
import random

import pytest

from terraweave.operators import grid

BOX = "fid int, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("scales", [(1,), (1, 4), (1, 8, 64)])
def test_boxes_of_all_sizes_meet_once(spark, scales):
    rng = random.Random(4)

    def boxes(n, seed):
        out = []
        for k in range(n):
            x, y, w = rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice([0.0, 5.0, 60.0, 700.0])
            out.append((k, x, y, x + w, y + w * rng.random()))
        return [*out, (n, 0.0, 0.0, 0.0, 0.0), (n + 1, 0.0, 0.0, 0.0, 0.0), (n + 2, None, 1.0, 2.0, 3.0)]

    a, b = boxes(60, 1), boxes(50, 2)
    for radius in (0.0, 7.5):
        got = grid.box_join(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), radius, 20.0, scales).select("l_fid", "r_fid").collect()
        want = {(p[0], q[0]) for p in a for q in b if p[1] is not None and q[1] is not None and q[1] <= p[3] + radius and q[3] >= p[1] - radius and q[2] <= p[4] + radius and q[4] >= p[2] - radius}
        assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("bucket", [None, 60, 86_400])
def test_the_last_row_before(spark, bucket):
    rng = random.Random(9)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(3000))
    left = [(rng.choice(["a", "b", None]), at(), k) for k in range(80)]
    right = list({(r[0], r[1]): r for r in [(rng.choice(["a", "a", "b"]), at(), float(k) if k % 5 else None) for k in range(40)]}.values())
    l, r = spark.createDataFrame(left, "k string, t timestamp, id int"), spark.createDataFrame(right, "k string, t timestamp, v double")
    got = {x.id: x.v for x in grid.as_of_join(l, r, ["k"], "t", ["v"], bucket).collect()}
    want = {}
    for k, t, i in left:
        earlier = [x for x in right if x[0] == k and x[1] <= t and k is not None]
        want[i] = max(earlier, key=lambda x: x[1])[2] if earlier else None
    assert got == want
    assert grid.as_of_join(l.limit(0), r, ["k"], "t", ["v"], bucket).count() == 0
