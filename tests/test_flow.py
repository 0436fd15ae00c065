"""Filling, catchments and stream orders against plain walks."""

import heapq
import math
import random

import numpy as np
import pytest

from arealis.operators import flow, raster
from arealis.sources import shared


def dem(spark, z):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, line in enumerate(z) for c, v in enumerate(line)], "row long, col long, v double")


def plain_fill(z):
    rows, cols = len(z), len(z[0])
    level, heap = {}, []
    for r in range(rows):
        for c in range(cols):
            if z[r][c] is not None and (r in (0, rows - 1) or c in (0, cols - 1)):
                level[r, c] = z[r][c]
                heap.append((z[r][c], r, c))
    heapq.heapify(heap)
    while heap:
        v, r, c = heapq.heappop(heap)
        for i in range(r - 1, r + 2):
            for j in range(c - 1, c + 2):
                if 0 <= i < rows and 0 <= j < cols and (i, j) not in level and z[i][j] is not None:
                    level[i, j] = max(v, z[i][j])
                    heapq.heappush(heap, (level[i, j], i, j))
    return {(r, c): None if z[r][c] is None else float(level.get((r, c), math.inf)) for r in range(rows) for c in range(cols)}


@pytest.mark.parametrize(("rows", "cols", "tile", "holes"), [(23, 31, 8, 0.0), (17, 19, 5, 0.25), (9, 9, 64, 0.0), (40, 7, 3, 0.1)])
def test_tiles_fill_like_one_flood(spark, rows, cols, tile, holes):
    rng = random.Random(rows)
    z = [[None if rng.random() < holes else rng.randrange(30) for _ in range(cols)] for _ in range(rows)]
    got = {(r.row, r.col): r.v for r in flow.fill_depressions(dem(spark, z), tile).collect()}
    assert got == plain_fill(z)


def test_a_long_valley_takes_few_jobs(spark, monkeypatch):
    n = 45  # a winding channel through high ground, its end deepest, with a sill on the way
    z, level = [[900] * n for _ in range(n)], 400
    for r in range(1, n - 1):
        for c in range(1, n - 1):
            if r % 4 == 1 or (r % 4 == 2 and c == n - 2) or (r % 4 == 3) and c == n - 2 and False or (r % 4 == 3 and c == 1) or (r % 4 == 0 and c == 1):
                level -= 0.01
                z[r][c] = level
    z[0][1] = 395
    written = []
    monkeypatch.setattr(flow, "cut", lambda df, *a: written.append(1) or shared.cut(df, *a))
    got = {(r.row, r.col): r.v for r in flow.fill_depressions(dem(spark, z), 6).collect()}
    assert got == plain_fill(z) and len(written) < 60


def test_empty_raster(spark):
    assert flow.fill_depressions(dem(spark, []).limit(0)).count() == 0
    assert flow.strahler(spark.createDataFrame([], "src long, dst long")).count() == 0


def plain_strahler(edges):
    kids, nodes = {}, {x for e in edges for x in e}
    for s, d in set(edges):
        kids.setdefault(d, []).append(s)
    out = {}
    def order(v):
        todo = [v]
        while todo:
            x = todo[-1]
            need = [k for k in kids.get(x, []) if k not in out]
            if need:
                todo += need
            else:
                o = sorted((out[k] for k in kids.get(x, [])), reverse=True)
                out[x] = 1 if not o else o[0] + (len(o) > 1 and o[0] == o[1])
                todo.pop()
    for v in nodes:
        if v not in out:
            order(v)
    return out


@pytest.mark.parametrize("reach", [1, 3, 40, 400])
def test_orders_of_random_forests(spark, reach):
    rng = random.Random(reach)
    edges = [(i, max(0, i - rng.randint(1, reach))) for i in range(1, 400) if rng.random() < 0.98]
    got = {r.node: r.ord for r in flow.strahler(spark.createDataFrame([*edges, edges[0], (None, 3), (7000, 7000)], "src long, dst long")).collect()}
    assert got == plain_strahler(edges)


def test_orders_of_circles_and_forks(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (10, 11), (12, 11)]
    got = {r.node: r.ord for r in flow.strahler(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {4: 1, 5: 1, 10: 1, 12: 1, 11: 2}
    with pytest.raises(ValueError):
        flow.strahler(spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"))


def test_a_river_of_ten_thousand_cells(spark, monkeypatch):
    n = 10_000
    rounds = []
    monkeypatch.setattr(flow, "cut", lambda df, *a: rounds.append(1) or shared.cut(df, *a))
    fork = [(n + i, i * 5) for i in range(1, 6)]  # five side streams
    edges = [(i, i + 1) for i in range(n)] + fork
    got = {r.node: r.ord for r in flow.strahler(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == plain_strahler(edges) and len(rounds) < 60
    rounds.clear()
    fdir = spark.range(n).selectExpr("0L as row", "id as col", "1 as dir")
    got = {r.col for r in raster.catchment(fdir, 0, 7000).collect()}
    assert got == set(range(7001)) and len(rounds) < 40


def test_catchment_with_other_ends(spark):
    rng = random.Random(3)
    z = [[rng.random() for _ in range(20)] for _ in range(20)]
    d = raster.flow_direction(dem(spark, z))
    to = {(r.row, r.col): (r.to_row, r.to_col) for r in raster.flow_edges(d).collect()}
    target = max(((r, c) for r in range(20) for c in range(20)), key=lambda t: sum(t == v for v in to.values()))

    def drains(p):
        while p != target and p in to:
            p = to[p]
        return p == target

    want = {(r, c) for r in range(20) for c in range(20) if drains((r, c))}
    assert {(r.row, r.col) for r in raster.catchment(d, *target).collect()} == want and len(want) > 3


def test_flood_labels():
    level, label, spill = flow.flood(np.array([[5.0, 5, 5, 5], [5, 1, 4, 5], [5, 5, 5, 3]]))
    assert level[1, 1] == 4 and level[1, 2] == 4 and label[1, 1] == label[1, 2] == label[2, 3]
    assert all(w == 5 for w in spill.values())


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that loops write."""
    import contextlib
    import io

    from arealis.operators import flow, network
    from arealis.sources.shared import cut

    seen = []

    def watched(df, *name):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        seen.append(out.getvalue())
        return cut(df, *name)

    for module in (raster, flow, network):
        monkeypatch.setattr(module, "cut", watched)
    return seen


def _packed(spark):
    """Cells of a slope read from files, which seem small enough to broadcast."""
    from arealis.sources.shared import cut

    return cut(spark.range(48).selectExpr("id div 8 as row", "id % 8 as col", "cast(id * 7 % 48 as double) as v"))


def test_flow_sends_no_cells_to_the_driver(spark, plans):
    acc = raster.flow_accumulation(raster.flow_direction(_packed(spark)))
    assert acc.count() == 48 and len(plans) > 3
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_catchments_and_orders_send_no_cells_to_the_driver(spark, plans):
    d = raster.cut(raster.flow_direction(_packed(spark)))
    e = raster.flow_edges(d).selectExpr("row * 8 + col as src", "to_row * 8 + to_col as dst")
    assert raster.catchment(d, 0, 0).count() >= 1 and raster.strahler(e).count() == 48 and len(plans) > 5
    assert not any("BroadcastHashJoin" in p for p in plans)
