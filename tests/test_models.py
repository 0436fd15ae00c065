"""Exact breaks, lag models, conditional permutations and reach areas against plain versions."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest

from arealis.operators import classify, lag_model, local_tests, network


def within(values, edges):
    total, lo = 0.0, -math.inf
    for e in edges:
        part = [v for v in values if lo < v <= e]
        lo = e
        total += sum((v - sum(part) / len(part)) ** 2 for v in part) if part else 0.0
    return total


@pytest.mark.parametrize("most", [20_000, 12])
def test_no_classes_are_closer_than_fishers(spark, most):
    rng = random.Random(7)
    for k in (2, 3, 5):
        values = [float(rng.choice([rng.randrange(30), 5, 5, 17])) for _ in range(40)]
        edges = classify.natural_breaks(spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double"), "v", k, most)
        different = sorted(set(values))
        best = min(within(values, [*c, different[-1]]) for c in itertools.combinations(different[:-1], k - 1))
        assert edges[0] == different[0] and edges[-1] == different[-1] and len(edges) == k + 1
        assert within(values, edges[1:]) <= best + (1e-9 if most > 100 else 0.05 * best)


def test_breaks_of_many_values_end_between_single_values(spark):
    rng = random.Random(2)
    values = [rng.gauss(m, 1.0) for m in (0, 10, 25) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert classify.natural_breaks(df, "v", 3, 300) == classify.natural_breaks(df, "v", 3)


def lattice(n):
    at = {(r, c): r * n + c for r in range(n) for c in range(n)}
    near = {i: [at[p] for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if p in at] for (r, c), i in at.items()}
    return [(i, j, 1.0 / len(v)) for i, v in near.items() for j in v]


@pytest.mark.parametrize(("n", "bound"), [(7, 1e-4), (22, 2e-2)])
def test_lag_model_equals_a_dense_fit(spark, n, bound):
    rng = np.random.default_rng(n)
    w = np.zeros((n * n, n * n))
    for i, j, v in lattice(n):
        w[i, j] = v
    x = rng.normal(size=n * n)
    y = np.linalg.solve(np.eye(n * n) - 0.6 * w, 1.0 + 2.0 * x + rng.normal(0, 0.5, n * n))
    xx = np.column_stack([np.ones(n * n), x])
    eig = np.linalg.eigvals(w).real

    def fit(rho):
        b = np.linalg.lstsq(xx, y - rho * (w @ y), rcond=None)[0]
        e = y - rho * (w @ y) - xx @ b
        return np.log(1 - rho * eig).sum() - n * n / 2 * (math.log(2 * math.pi) + math.log(e @ e / n / n) + 1), b

    rho = max(np.linspace(-0.99, 0.99, 19801), key=lambda r: fit(r)[0])
    df = spark.createDataFrame([(i, float(y[i]), float(x[i])) for i in range(n * n)] + [(9999, None, 1.0)], "id long, y double, x double")
    got = {r.term: r for r in lag_model.spatial_lag_ml(df, spark.createDataFrame(lattice(n) + [(0, 9999, 0.5)], "i long, j long, w double"), "y", ["x"], terms=24, probes=50).collect()}
    assert abs(got["rho"].coefficient - rho) < bound and abs(got["x"].coefficient - fit(rho)[1][1]) < bound
    assert n > 7 or abs(got["rho"].log_likelihood - fit(rho)[0]) < 1e-3
    bend = (fit(rho + 1e-3)[0] - 2 * fit(rho)[0] + fit(rho - 1e-3)[0]) / 1e-6
    assert got["rho"].n == n * n and abs(got["rho"].std_error * math.sqrt(-bend) - 1) < 0.1


def test_bijection():
    for n in (1, 2, 3, 17, 100, 1000):
        for key in (0, 5, 123456):
            assert sorted(local_tests.feistel(np.arange(n), n, key).tolist()) == list(range(n))


@pytest.mark.parametrize(("statistic", "values"), [("moran", 2_000_000), ("gi_star", 2_000_000), ("moran", 300)])
def test_conditional_permutations_equal_a_loop(spark, statistic, values):
    rng = random.Random(3)
    n, runs = 36, 99
    y = [rng.gauss(0, 1) + (2 if i < 12 else 0) for i in range(n)]
    w = [(i, j, 1.0) for i, j, _ in lattice(6) if i != 35]
    df = spark.createDataFrame([(10 * i, v) for i, v in enumerate(y)] + [(9999, None)], "id long, y double")
    W = spark.createDataFrame([(10 * i, 10 * j, v) for i, j, v in w], "i long, j long, w double")
    got = {r.id: r for r in local_tests.permutation_p(df, W, "y", statistic, runs, seed=4, values=values).collect()}
    mean = sum(y) / n
    var = sum((v - mean) ** 2 for v in y) / n
    for i in range(n):
        near = [(j, v) for a, j, v in w if a == i]
        if not near:
            assert got[10 * i].p_sim is None
            continue
        z = [v - mean for v in y] if statistic == "moran" else y

        def value(total):
            return (n - 1) * z[i] * total / (n * var) if statistic == "moran" else (total + z[i]) / sum(y) / (len(near) + 1)

        seen = value(sum(v * z[j] for j, v in near))
        more = 0
        for r in range(runs):
            others = [j for j in range(n) if j != i]
            places = local_tests.feistel(np.arange(len(near)), n - 1, 4 * 1_000_003 + r)
            more += value(sum(v * z[others[p]] for p, (_, v) in zip(places, near))) >= seen
        assert abs(got[10 * i].value - seen) < 1e-9
        assert abs(got[10 * i].p_sim - (min(more, runs - more) + 1) / (runs + 1)) < 1e-9
    assert len(got) == n


def test_reach_areas(spark):
    rng = random.Random(1)
    n = 9
    edges = {(r * n + c, q * n + d): rng.randrange(1, 6) for r in range(n) for c in range(n) for q, d in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if 0 <= q < n and 0 <= d < n}
    frame = spark.createDataFrame([(a, b, float(m)) for (a, b), m in edges.items()], "src long, dst long, minutes double")
    nodes = spark.createDataFrame([(i, 1000.0 * (i % n), 1000.0 * (i // n)) for i in range(n * n)], "node long, x double, y double")
    sources = spark.createDataFrame([(1, 0), (2, 44), (3, 80)], "source long, node long")
    out = network.isochrone_areas(frame, nodes, sources, [1.0, 5.0, 8.0])
    got = {(r.source, r.minutes): (r.nodes, round(r.area_km2, 6)) for r in out.collect()}
    want, cells = {}, {}
    for s, start in ((1, 0), (2, 44), (3, 80)):
        cost, heap = {}, [(0, start)]
        while heap:
            d, v = heapq.heappop(heap)
            if v not in cost:
                cost[v] = d
                heap += [(d + m, b) for (a, b), m in edges.items() if a == v]
                heapq.heapify(heap)
        for limit in (1.0, 5.0, 8.0):
            pts = sorted({(v % n, v // n) for v, d in cost.items() if d <= limit})
            hull = []
            for part in (pts, pts[::-1]):
                side = []
                for p in part:
                    while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                        side.pop()
                    side.append(p)
                hull += side[:-1]
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1])) / 2
            if area > 0:
                want[s, limit] = (len(pts), float(area))
                cells.setdefault(limit, []).append(hull)
    assert got == want
    union = {r.minutes: (r.facilities, r.area_km2) for r in network.dissolved_isochrones(out, 2500.0).collect()}
    steps = 40
    for limit, hulls in cells.items():
        inside = lambda x, y, h: all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(h, h[1:] + h[:1]))
        area = sum(any(inside((i + 0.5) / steps, (j + 0.5) / steps, h) for h in hulls) for i in range((n - 1) * steps) for j in range((n - 1) * steps)) / steps**2
        assert union[limit][0] == len(hulls) and abs(union[limit][1] - area) < 0.15


def test_equal_sums_count_whatever_their_order(spark):
    df = spark.createDataFrame(list(enumerate([0.1, 0.2, 0.3, 0.7])), "id long, y double")
    W = spark.createDataFrame([(i, j, 1.0) for i in range(4) for j in range(4) if i != j], "i long, j long, w double")
    got = local_tests.permutation_p(df, W, "y", "gi_star", 99).collect()
    assert [r.p_sim for r in got] == [1 / 100] * 4


def test_local_tests_send_no_places_to_the_driver(spark, monkeypatch):
    import contextlib
    import io

    plans, cut = [], local_tests.cut

    def watched(d, *name):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            d.explain()
        plans.append(out.getvalue())
        return cut(d, *name)

    df = cut(spark.range(30).selectExpr("id", "cast(id * 7 % 30 as double) as y"))
    W = cut(spark.range(29).selectExpr("id as i", "id + 1 as j", "1.0D as w"))
    monkeypatch.setattr(local_tests, "cut", watched)
    assert local_tests.permutation_p(df, W, "y", "moran", 9).count() == 30 and len(plans) == 3
    assert "BroadcastHashJoin" not in plans[1]
