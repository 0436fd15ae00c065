"""Nearest points against all pairs, in places of very different density."""

import math
import random

import pytest

from arealis.operators import nearest


@pytest.mark.parametrize(("k", "limit"), [(1, None), (5, None), (3, 0.4)])
def test_nearest_equals_all_pairs(spark, monkeypatch, k, limit):
    monkeypatch.setattr(nearest, "CAP", 4)
    rng = random.Random(k)
    right = [(i, rng.random() * 100, rng.random() * 100) for i in range(60)]
    right += [(100 + i, 40 + rng.random() * 0.01, 70 + rng.random() * 0.01) for i in range(120)]  # a cluster
    right += [(300 + i, 5.0, 5.0) for i in range(9)] + [(400, 10.0, 20.0), (401, 12.0, 20.0), (500, None, 1.0)]
    left = [(i, rng.random() * 110 - 5, rng.random() * 110 - 5) for i in range(60)] + [(70, 11.0, 20.0), (71, 5.0, 5.0), (72, 40.005, 70.005), (73, -900.0, 40.0), (74, 1e6, 1e6), (75, None, 2.0)]
    l, r = spark.createDataFrame(left, "id int, x double, y double"), spark.createDataFrame(right, "j int, x double, y double")
    got = {(p.id, p.j) for p in nearest.nearest_join(l, r, "id", "j", max_distance=limit, k=k).collect()}
    want = set()
    for i, x, y in left:
        if x is not None:
            d = sorted((round(math.hypot(x - u, y - v), 9), j) for j, u, v in right if u is not None)
            want |= {(i, j) for n, j in d if n <= d[k - 1][0] and (limit is None or n <= limit)}
    assert got == want


def test_few_and_no_points(spark):
    l = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "id int, x double, y double")
    r = spark.createDataFrame([(7, 3.0, 0.0)], "j int, x double, y double")
    assert {(p.id, p.j, p.d) for p in nearest.nearest_join(l, r, "id", "j", k=3).collect()} == {(1, 7, 3.0), (2, 7, 4.0)}
    assert nearest.nearest_join(l, r.limit(0), "id", "j").count() == nearest.nearest_join(l.limit(0), r, "id", "j").count() == 0
