"""Hand-worked cases of geometry, joins by place, statistics, rasters and networks."""

import math
import random

from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.functions.columns import utm
from arealis.operators import network, overlay, rank, raster, spatial, stats


def ring(*pts):
    return [[{"x": float(x), "y": float(y)} for x, y in pts]]


RINGS = "array<array<struct<x:double,y:double>>>"
L_SHAPE = ring((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))


def test_geometry_of_an_l_shape(spark):
    df = spark.createDataFrame([(L_SHAPE, ring((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)))], f"a {RINGS}, b {RINGS}")
    row = df.select(g.area(F.col("a")), g.clip_area(F.col("a"), F.get("b", F.lit(0))), g.perimeter(F.col("a")), g.contains(F.col("a"), F.lit(1.5), F.lit(1.5)), g.contains(F.col("a"), F.lit(0.5), F.lit(1.5)), g.is_valid(F.col("a"))).first()
    assert [round(v, 9) if isinstance(v, float) else v for v in row] == [3.0, 0.75, 8.0, False, True, True]


def test_bow_tie_is_invalid_and_holes_count(spark):
    hole = [L_SHAPE[0], [{"x": 0.25, "y": 0.25}, {"x": 0.75, "y": 0.25}, {"x": 0.75, "y": 0.75}, {"x": 0.25, "y": 0.75}]]
    df = spark.createDataFrame([(1, ring((0, 0), (1, 1), (1, 0), (0, 1))), (2, hole)], f"id int, r {RINGS}")
    got = {r.id: r for r in df.select("id", g.is_valid(F.col("r")).alias("ok"), g.area(F.col("r")).alias("a"), g.contains(F.col("r"), F.lit(0.5), F.lit(0.5)).alias("inside")).collect()}
    assert not got[1].ok and got[2].ok and math.isclose(got[2].a, 2.75) and not got[2].inside


def test_utm_of_a_known_place(spark):
    df = spark.createDataFrame([(9.0, 0.0), (10.0, 50.0)], "lon double, lat double")
    e, n = utm(F.col("lon"), F.col("lat"), F.lit(32))
    got = [(round(r[0], 2), round(r[1], 2)) for r in df.select(e, n).collect()]
    assert got[0] == (500000.0, 0.0)
    assert math.isclose(got[1][0], 571666.45, abs_tol=0.1) and math.isclose(got[1][1], 5539109.82, abs_tol=0.1)


def lattice(spark, n=5):
    data = [(r * n + c, ring((c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1)), float((r * 7 + c * 3) % 11)) for r in range(n) for c in range(n)]
    return spark.createDataFrame(data, f"id long, rings {RINGS}, y double")


def test_weights_of_lattice_and_strip(spark):
    df = lattice(spark)
    assert stats.weights(df, "queen").count() == 144 and stats.weights(df, "rook").count() == 80
    strip = spark.createDataFrame([(i, ring((i - 100, i + 40), (i - 99, i + 40), (i - 99, i + 41), (i - 100, i + 41))) for i in range(5)], f"id long, rings {RINGS}")
    assert stats.weights(strip, "queen").count() == 8 and stats.weights(strip, "rook").count() == 0
    assert stats.drop_islands(strip, stats.weights(strip, "rook")).count() == 0


def test_cell_join_equals_cross_join(spark):
    rng = random.Random(2)
    a = [(i, rng.random() * 3, rng.random() * 3) for i in range(60)]
    b = [(i, rng.random() * 3, rng.random() * 3) for i in range(60)]
    left, right = spark.createDataFrame(a, "id int, x double, y double"), spark.createDataFrame(b, "j int, x2 double, y2 double")
    got = {(r.id, r.j) for r in spatial.near_pairs(left, right, 0.4).collect()}
    assert got == {(i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= 0.4}


def test_apportioned_population_of_a_cover_is_the_total(spark):
    tracts = lattice(spark).withColumn("pop", F.col("y") * 10)
    zones = spark.createDataFrame([(1, ring((0, 0), (2.5, 0), (2.5, 5), (0, 5))), (2, ring((2.5, 0), (5, 0), (5, 5), (2.5, 5))), (3, ring((9, 9), (10, 9), (10, 10), (9, 10)))], f"z int, rings {RINGS}")
    got = {r.z: r.pop for r in spatial.apportion(zones, tracts, "z", "id", ["pop"], 1.0).collect()}
    total = tracts.agg(F.sum("pop")).first()[0]
    assert math.isclose(got[1] + got[2], total) and got[3] == 0.0


def test_nearest_keeps_ties(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    right = spark.createDataFrame([(1, 3.0, 0.0), (2, -3.0, 0.0), (3, 9.0, 0.0)], "j int, x double, y double")
    assert sorted((r.j, r.d) for r in spatial.nearest_join(left, right, "id", "j", 1.0).collect()) == [(1, 3.0), (2, 3.0)]


def test_thinning_equals_the_walk(spark):
    rng = random.Random(5)
    pts = [(i, rng.random() * 4, rng.random() * 4) for i in range(80)]
    kept = []
    for p in pts:
        if all(math.hypot(p[1] - q[1], p[2] - q[2]) >= 0.5 for q in kept):
            kept.append(p)
    got = {r.id for r in rank.thin(spark.createDataFrame(pts, "id int, x double, y double"), "id", "x", "y", 0.5).collect()}
    assert got == {p[0] for p in kept}


def test_thinning_query_walks_all_customers(spark):
    from arealis.plans import places

    points = spark.range(1, 121).selectExpr("id c_custkey", "'a' c_mktsegment", "0.0D c_acctbal")
    kept = []
    for i in range(1, 121):
        p = i * 37 % 5000 / 1000, i * 91 % 5000 / 1000
        if all(math.hypot(p[0] - q[1], p[1] - q[2]) >= 0.3 for q in kept):
            kept.append((i, *p))
    tables = type("T", (), {"customer": points})()
    assert {r.id for r in places.thinning(tables).collect()} == {p[0] for p in kept}


def dem(spark, z):
    return spark.createDataFrame([(r, c, float(v)) for r, line in enumerate(z) for c, v in enumerate(line)], "row long, col long, v double")


def test_plane_slopes_and_flow(spark):
    plane = dem(spark, [[9 - c for c in range(4)] for _ in range(4)])
    assert {round(r.slope, 9) for r in raster.terrain(plane).collect()} == {45.0}
    codes = {(r.row, r.col): r.dir for r in raster.flow_direction(plane).collect()}
    assert {codes[r, c] for r in (1, 2) for c in (0, 1, 2)} == {1}


def test_pit_fills_and_water_adds_up(spark):
    pit = [[9, 9, 9, 9, 9], [9, 5, 5, 5, 9], [9, 5, 1, 5, 4], [9, 5, 5, 5, 9], [9, 9, 9, 9, 9]]
    got = {(r.row, r.col): r.v for r in raster.fill_depressions(dem(spark, pit)).collect()}
    assert got[2, 2] == 5 and got[2, 4] == 4 and got[0, 0] == 9
    slope = dem(spark, [[20 - r - 3 * (c == 1) for c in range(3)] for r in range(4)])
    acc = {(r.row, r.col): r.acc for r in raster.flow_accumulation(raster.flow_direction(slope)).collect()}
    assert acc[3, 1] == 12


def test_strahler_of_a_y(spark):
    e = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (5, 4)], "src long, dst long")
    assert {r.node: r.ord for r in raster.strahler(e).collect()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1}


def test_network_with_a_cut(spark):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0), (2, 5, 5.0)]
    e = spark.createDataFrame(edges + [(b, a, m) for a, b, m in edges], "src long, dst long, minutes double")
    o = spark.createDataFrame([(n,) for n in range(7)], "node long")
    f = spark.createDataFrame([("a", 0), ("b", 5)], "facility string, node long")
    got = {r.node: (r.facility, r.cost) for r in network.nearest_facility(e, o, f).collect()}
    assert got == {0: ("a", 0.0), 1: ("a", 1.0), 2: ("a", 2.0), 5: ("b", 0.0), 3: (None, None), 4: (None, None), 6: (None, None)}
    assert {r.node: r.component for r in network.components(e).collect()} == {0: 0, 1: 0, 2: 0, 5: 0, 3: 3, 4: 3}
    near = network.isochrones(e, spark.createDataFrame([(9, 0)], "source long, node long"), [1.0, 10.0])
    assert {r.minutes: r.nodes for r in near.collect()} == {1.0: 2, 10.0: 4}


def test_nearest_facility_takes_few_rounds_on_a_long_road(spark, monkeypatch):
    hops, rounds = 400, []
    e = spark.createDataFrame([(i + d, i + 1 - d, 1.0) for i in range(hops) for d in (0, 1)], "src long, dst long, minutes double")
    f = spark.createDataFrame([("b", 0), ("a", 0), ("c", 150)], "facility string, node long")
    real = network.cut
    monkeypatch.setattr(network, "cut", lambda df, *a: rounds.append(1) or real(df, *a))
    for size in (50_000, 60):
        rounds.clear()
        got = {r.node: (r.facility, r.cost) for r in network.nearest_facility(e, e.select(F.col("dst").alias("node")).distinct(), f, 200.0, block_nodes=size).collect()}
        assert got == {n: ("a", float(n)) if n <= 75 else ("c", abs(n - 150.0)) if n <= 350 else (None, None) for n in range(hops + 1)}
        assert len(rounds) < 40
    one = spark.createDataFrame([(7,), (None,)], "node long")
    assert {(r.node, r.facility) for r in network.nearest_facility(e, one, f.limit(0)).collect()} == {(7, None), (None, None)}


def test_point_on_surface_computes_the_box_once(spark):
    rings = [ring((0, 0), (2, 0), (2, 2), (0, 2)), L_SHAPE, None, [[]]]
    df = spark.createDataFrame(list(enumerate(rings)), f"id int, rings {RINGS}").select("id", "rings", g.point_on_surface(F.get("rings", F.lit(0))).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("array_min") == 2
    got = {r.id: r.p for r in df.collect()}
    assert (got[0].x, round(got[0].y, 6)) == (1.0, 1.0) and got[2] is None and got[3] is None
    inside = df.where(g.contains(F.col("rings"), F.col("p.x"), F.col("p.y"))).select("id").collect()
    assert {r.id for r in inside} == {0, 1}


def test_hot_spots_broadcast_nothing_that_grows(spark, monkeypatch):
    monkeypatch.setattr(stats, "cut", lambda df: df)
    x, y = (F.col("id") % 5).cast("double"), F.floor(F.col("id") / 5).cast("double")
    df = spark.range(25).select("id", g.box(x, y, x + 1, y + 1).alias("rings"), F.when(F.col("id") < 10, 9.0).otherwise(F.col("id") % 3).alias("y"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    w = stats.weights(df, "queen")
    assert "BroadcastHashJoin" not in plan(w) and "BroadcastHashJoin" not in plan(stats.lag(w, df, "y"))
    scores = stats.hotspots(df, w, "y", fdr=False)
    assert "BroadcastHashJoin" not in plan(scores) and "BroadcastHashJoin" not in plan(overlay.persistent(scores, scores, "id"))
    assert {r.id for r in overlay.persistent(scores, stats.hotspots(df, w, "y"), "id").collect()} <= set(range(10))


def test_moran_of_halves_is_clustered(spark):
    df = lattice(spark).withColumn("y", F.when(F.col("id") < 12, 1.0).otherwise(5.0))
    m = stats.moran_gate(stats.morans_i(df, stats.weights(df, "rook"), "y")).first()
    assert m.moran_i > 0.3 and m.verdict == "clustered" and m.gate and m.strength == "strong"
    p = stats.permutation_p(df, stats.weights(df, "rook"), "y", n=49).first().p_sim
    assert p == 1 / 50


def test_predicates_of_polygons_and_right_join(spark):
    left = spark.createDataFrame([(1, ring((0, 0), (2, 0), (2, 2), (0, 2))), (2, L_SHAPE)], f"id int, rings {RINGS}")
    boxes = {"same": (0, 0, 2, 2), "beside": (2, 0, 3, 2), "corner": (2, 2, 3, 3), "part": (1.5, 0.5, 2.5, 0.9), "notch": (1, 1, 2, 2), "far": (8, 8, 9, 9)}
    right = spark.createDataFrame([(n, ring((a, b), (c, b), (c, d), (a, d))) for n, (a, b, c, d) in boxes.items()], f"name string, rings2 {RINGS}")
    got = {p: {(r.id, r.name) for r in spatial.spatial_join(left, right, "id", p).select("id", "name").collect()} for p in ("overlaps", "touches", "within")}
    assert got["overlaps"] == {(1, "part"), (2, "part")}
    assert got["touches"] == {(1, "beside"), (1, "corner"), (2, "beside"), (2, "notch")}
    assert got["within"] == {(1, "same"), (2, "same")}
    points = spark.createDataFrame([("p", 0.5, 0.5), ("p", 0.5, 0.5), ("q", 9.0, 9.0), (None, None, 1.0)], "n string, x double, y double")
    rows = spatial.spatial_join(left.where("id = 1"), points, "id", "contains", "right").select("id", "n").collect()
    assert [(r.id, r.n) for r in rows].count((1, "p")) == 2 and sum(r.id is None for r in rows) == 2 and len(rows) == 4


def test_clip_by_polygons_with_a_hole(spark):
    cells_ = spark.createDataFrame([(r, c, 1.0) for r in range(5) for c in range(5)], "row long, col long, v double")
    hole = [ring((0.6, 0.6), (4.4, 0.6), (4.4, 4.4), (0.6, 4.4))[0], ring((1.4, 1.4), (3.6, 1.4), (3.6, 3.6), (1.4, 3.6))[0]]
    masks = spark.createDataFrame([(hole,), (hole,), (None,)], f"rings {RINGS}")
    centres = {(r.row, r.col) for r in raster.clip_by_polygons(cells_, masks).collect()}
    touched = {(r.row, r.col) for r in raster.clip_by_polygons(cells_, masks, all_touched=True).collect()}
    border = {(r, c) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4)}
    assert not centres & border and (2, 2) not in centres and centres == set()
    assert touched == {(r, c) for r in range(5) for c in range(5)} - {(2, 2)}


def test_moran_of_groups_equals_each_alone(spark):
    grid = [(r * 5 + c, r, c) for r in range(5) for c in range(5)]
    areas_ = spark.createDataFrame([(i, ring((c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1))) for i, r, c in grid], f"id long, rings {RINGS}")
    W = stats.weights(areas_, "queen")
    rows = [("a", i, float(r * 3 + c)) for i, r, c in grid] + [("b", i, float((r * 7 + c * 5) % 4)) for i, r, c in grid] + [("few", i, float(i)) for i in range(4)] + [("few", 9, None)]
    df = spark.createDataFrame(rows, "project string, id long, y double")
    got = {r.project: r for r in stats.morans_by(df, W, "y", "project").collect()}
    for p in ("a", "b"):
        one = stats.morans_i(df.where(F.col("project") == p).drop("project"), stats.row_standardise(W), "y").first()
        assert all(math.isclose(got[p][c], one[c], abs_tol=1e-9) for c in ("moran_i", "expected", "z", "p")) and got[p].verdict == one.verdict
    assert got["few"].n == 4 and got["few"].moran_i is None


def test_pairs_are_of_different_places(spark, monkeypatch):
    near, seen = spatial.near_pairs, []

    def counted(*args, **kw):
        out = near(*args, **kw)
        seen.append(out.count())
        return out

    for module in (spatial, rank):
        monkeypatch.setattr(module, "near_pairs", counted)
    rows = [(i, i % 2 * 0.1, 0.0, "ab"[i % 4 // 2]) for i in range(40)]
    here = spark.createDataFrame([*rows, (98, 9.0, 9.0, "a"), (99, None, 0.0, "a")], "id int, x double, y double, kind string")
    layer = spark.createDataFrame(rows, here.schema)
    n = {r.id: r.n_within for r in spatial.count_within_distance(here, layer, "id", 0.5).collect()}
    assert n == {**{i: 40 for i in range(40)}, 98: 0, 99: 0}
    assert {r.id for r in spatial.exclude_near(here, layer, "id", 0.5).collect()} == {98, 99}
    bands = {(r.id, r.band, r.kind): r.n for r in spatial.band_profile(here, layer, "id", [0.05, 0.5], "kind").collect()}
    assert bands == {(i, b, k): 10 for i in range(40) for b in (0.05, 0.5) for k in "ab"}
    assert {r.id for r in rank.thin(here, "id", "x", "y", 0.3).collect()} == {0, 98, 99}
    assert max(seen) <= 10


def test_shares_of_boxes_are_products_of_sides(spark, monkeypatch):
    clipped = []
    pairs = spatial.box_pairs
    monkeypatch.setattr(spatial, "box_pairs", lambda *a: clipped.append(pairs(*a).count()) or pairs(*a))
    box = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d))
    at = {i: (0.6 + i * 0.037, 0.7 + i * 0.053) for i in range(12)}
    zones = {i: box(x - 0.4, y - 0.4, x + 0.4, y + 0.4) for i, (x, y) in at.items()}
    rows = [*zones.items(), *((i + 100, z) for i, z in zones.items()), (50, ring((0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)))]
    z = spark.createDataFrame(rows, f"zone int, rings {RINGS}")
    t = spark.createDataFrame([(7, box(0, 0, 1, 1)), (8, L_SHAPE)], f"tract int, rings {RINGS}")
    got = {(r.zone, r.tract): r.frac for r in spatial.overlaps(z, t, "zone", "tract", 1.0).collect()}
    for i, (x, y) in at.items():
        share = max(min(x + 0.4, 1.0) - max(x - 0.4, 0.0), 0.0) * max(min(y + 0.4, 1.0) - max(y - 0.4, 0.0), 0.0)
        assert got.get((i, 7), 0.0) == got.get((i + 100, 7), 0.0) == share
    assert abs(got[50, 7] - 0.5) < 1e-12 and abs(got[50, 8] - 0.5 / 3) < 1e-12
    assert clipped[0] <= 2 * 13


def test_interiors_leave_out_shapes_that_only_touch(spark):
    box = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d))
    left = spark.createDataFrame([(1, box(0, 0, 1, 1)), (2, box(0, 0, 1, 1)), (3, box(0.5, 0.5, 1.5, 1.5))], f"id int, rings {RINGS}")
    right = spark.createDataFrame([("beside", box(1, 0, 2, 1)), ("corner", box(1, 1, 2, 2)), ("same", box(0, 0, 1, 1)), ("again", box(0, 0, 1, 1))], f"name string, rings2 {RINGS}")
    got = {(r.id, r.name) for r in spatial.spatial_join(left, right, "id", "interiors").collect()}
    assert got == {(1, "same"), (1, "again"), (2, "same"), (2, "again"), (3, "beside"), (3, "corner"), (3, "same"), (3, "again")}
