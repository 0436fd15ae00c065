"""Queries over places: points and polygons that both engines derive from the tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.functions.columns import utm, utm_zone, web_mercator
from arealis.operators import network, profile, quality, raster, rank, spatial, stats
from arealis.plans.registry import Tables, query, r6, select6


def areas(t: Tables) -> DataFrame:
    """``nation`` as the unit boxes of a 5x5 lattice."""
    x, y = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"))
    return n.select("id", g.box(F.col("x0"), F.col("y0"), F.col("x0") + 1, F.col("y0") + 1).alias("rings"))


def people(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 5000 / 1000).alias("x"), (F.col("c_custkey") * 91 % 5000 / 1000).alias("y"), "c_mktsegment", "c_acctbal")


def shops(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("sid"), (F.col("s_suppkey") * 53 % 5000 / 1000).alias("x"), (F.col("s_suppkey") * 17 % 5000 / 1000).alias("y"))


_AREAS = "(SELECT CAST(n_nationkey AS BIGINT) id, CAST(n_nationkey % 5 AS DOUBLE) x0, CAST(n_nationkey // 5 AS DOUBLE) y0 FROM nation)"
_PEOPLE = "(SELECT c_custkey id, c_custkey * 37 % 5000 / 1000 AS x, c_custkey * 91 % 5000 / 1000 AS y, c_mktsegment, c_acctbal FROM customer)"
_SHOPS = "(SELECT s_suppkey sid, s_suppkey * 53 % 5000 / 1000 AS x, s_suppkey * 17 % 5000 / 1000 AS y FROM supplier)"


def zones(t: Tables, r: float = 0.7) -> DataFrame:
    """Boxes of side ``2 r`` around shops, cut at nothing."""
    s = shops(t)
    return s.select("sid", g.box(F.col("x") - r, F.col("y") - r, F.col("x") + r, F.col("y") + r).alias("rings"))


def tracts(t: Tables) -> DataFrame:
    n = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.count("*").cast("double").alias("pop"), F.avg("c_acctbal").alias("income"))
    return areas(t).join(n, "id", "left")


_TRACTS = f"(SELECT a.id, x0, y0, pop, income FROM {_AREAS} a LEFT JOIN (SELECT c_nationkey id, CAST(count(*) AS DOUBLE) pop, avg(c_acctbal) income FROM customer GROUP BY 1) c USING (id))"


def _frac(r: float) -> str:
    return f"greatest(least(x + {r}, x0 + 1) - greatest(x - {r}, x0), 0) * greatest(least(y + {r}, y0 + 1) - greatest(y - {r}, y0), 0)"


@query(f"SELECT a.id, count(p.x) AS n_points FROM {_AREAS} a LEFT JOIN {_PEOPLE} p ON p.x >= x0 AND p.x < x0 + 1 AND p.y >= y0 AND p.y < y0 + 1 GROUP BY 1")
def count_within(t: Tables) -> DataFrame:
    return spatial.count_within(areas(t), people(t), "id", 1.0)


@query(f"SELECT a.id, p.id AS person FROM {_AREAS} a JOIN {_PEOPLE} p ON p.x >= x0 AND p.x < x0 + 1 AND p.y >= y0 AND p.y < y0 + 1")
def spatial_join_points(t: Tables) -> DataFrame:
    return spatial.spatial_join(areas(t), people(t).select(F.col("id").alias("person"), "x", "y"), "id").select("id", "person")


@query(f"SELECT z.sid, a.id FROM {_SHOPS} z JOIN {_AREAS} a ON {_frac(0.7)} > 1e-12")
def spatial_join_areas(t: Tables) -> DataFrame:
    right = areas(t).select("id", F.col("rings").alias("rings2"))
    return spatial.spatial_join(zones(t), right, "sid", "interiors").select("sid", "id")


@query(f"""
WITH d AS (SELECT p.id, s.sid, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS d FROM {_PEOPLE} p, {_SHOPS} s),
m AS (SELECT id, sid, d, rank() OVER (PARTITION BY id ORDER BY round(d, 9)) r FROM d)
SELECT id, min(sid) AS sid, round(min(d), 6) AS d FROM m WHERE r = 1 GROUP BY id""")
def nearest_supplier(t: Tables) -> DataFrame:
    n = spatial.nearest_join(people(t).select("id", "x", "y"), shops(t), "id", "sid", 0.25)
    return n.groupBy("id").agg(F.min("sid").alias("sid"), F.round(F.min("d"), 6).alias("d"))


@query(f"SELECT s.sid, count(p.id) AS n_within FROM {_SHOPS} s LEFT JOIN {_PEOPLE} p ON sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) <= 0.5005 GROUP BY 1")
def within_km(t: Tables) -> DataFrame:
    return spatial.count_within_distance(shops(t), people(t), "sid", 0.5005)


@query(f"""SELECT s.sid, CASE WHEN d <= 0.3005 THEN 0.3005 ELSE 0.8005 END AS band, c_mktsegment, count(*) n FROM (SELECT s.sid, c_mktsegment, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS d FROM {_SHOPS} s, {_PEOPLE} p) s WHERE d <= 0.8005 GROUP BY 1, 2, 3""")
def band_profile(t: Tables) -> DataFrame:
    return spatial.band_profile(shops(t), people(t), "sid", [0.3005, 0.8005], "c_mktsegment")


@query(f"SELECT p.id FROM {_PEOPLE} p WHERE NOT EXISTS (SELECT 1 FROM {_SHOPS} s WHERE sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) < 0.2005)")
def exclude_near(t: Tables) -> DataFrame:
    return spatial.exclude_near(people(t), shops(t), "id", 0.2005).select("id")


@query(f"SELECT p.id FROM {_PEOPLE} p WHERE x < 2 AND y < 1")
def clip_points(t: Tables) -> DataFrame:
    return spatial.clip_points(people(t), areas(t).where("id in (0, 1)"), "id", 1.0).select("id")


@query(f"SELECT z.sid, round(sum(income * f) / nullif(sum(f) FILTER (WHERE income IS NOT NULL), 0), 6) AS income, count(*) AS n_tracts FROM (SELECT z.sid, income, {_frac(0.7)} AS f FROM {_SHOPS} z, {_TRACTS} a) z WHERE f > 1e-12 GROUP BY 1")
def areal_mean(t: Tables) -> DataFrame:
    return select6(spatial.areal_weighted_mean(zones(t), tracts(t), "sid", "id", ["income"], 1.0), "sid")


@query(f"""SELECT z.sid, round(coalesce(sum(pop * f), 0), 6) AS pop, round(sum(income * pop * f) / nullif(sum(pop * f), 0), 6) AS income FROM (SELECT z.sid, pop, income, {_frac(0.7)} AS f FROM {_SHOPS} z, {_TRACTS} a) z WHERE f > 1e-12 GROUP BY 1""")
def apportion(t: Tables) -> DataFrame:
    return select6(spatial.apportion(zones(t), tracts(t), "sid", "id", ["pop"], 1.0, {"income": "pop"}), "sid")


@query(f"""
WITH z AS (SELECT sid, pop, {_frac(0.4)} AS f1, {_frac(0.9)} AS f2 FROM {_SHOPS} z, {_TRACTS} a),
s AS (SELECT sid, coalesce(sum(pop * f1), 0) c1, coalesce(sum(pop * f2), 0) c2 FROM z GROUP BY 1)
SELECT sid, 1 AS ring, round(c1, 6) AS cumulative, round(c1, 6) AS in_ring FROM s UNION ALL SELECT sid, 2, round(c2, 6), round(c2 - c1, 6) FROM s""")
def ring_demographics(t: Tables) -> DataFrame:
    rings = zones(t, 0.4).withColumn("ring", F.lit(1)).unionByName(zones(t, 0.9).withColumn("ring", F.lit(2)))
    out = spatial.ring_demographics(rings, tracts(t), "sid", "id", "pop", 1.0)
    return out.select("sid", "ring", F.round("cumulative", 6).alias("cumulative"), F.round("in_ring", 6).alias("in_ring"))


@query(f"""
WITH z AS (SELECT sid, x, y, pop, x0, y0, {_frac(0.7)} AS f FROM {_SHOPS} z, {_TRACTS} a)
SELECT sid, round(CASE WHEN sum(pop * f) > 0 THEN sum(pop * f * (x0 + 0.5)) / sum(pop * f) ELSE any_value(x) END, 6) AS x, round(CASE WHEN sum(pop * f) > 0 THEN sum(pop * f * (y0 + 0.5)) / sum(pop * f) ELSE any_value(y) END, 6) AS y FROM z GROUP BY sid""")
def weighted_centroid(t: Tables) -> DataFrame:
    return select6(spatial.weighted_centroid(zones(t), tracts(t), "sid", "id", "pop", 1.0), "sid")


@query(f"""
WITH c AS (SELECT id, x0 + 0.5 AS cx, y0 + 0.5 AS cy, x0, y0 FROM {_AREAS})
SELECT c.id, round_even(CAST(count(*) FILTER (WHERE s.x >= x0 AND s.x < x0 + 1 AND s.y >= y0 AND s.y < y0 + 1) AS DOUBLE), 4) AS density, round_even(min(sqrt((s.x - cx) ** 2 + (s.y - cy) ** 2)), 3) AS gap FROM c, {_SHOPS} s GROUP BY 1""")
def competitor_metrics(t: Tables) -> DataFrame:
    return spatial.competitor_metrics(areas(t), shops(t).drop("sid"), "id", 1.0, 0.5)


@query(f"""SELECT id, kind, round(least(sum(f), 1), 6) AS share, round(least(sum(f), 1) * any_value(pop), 6) AS exposed FROM (SELECT a.id, z.sid % 3 AS kind, pop, {_frac(0.1)} AS f FROM {_SHOPS} z, {_TRACTS} a) WHERE f > 1e-12 GROUP BY 1, 2""")
def area_share(t: Tables) -> DataFrame:
    z = zones(t, 0.1).withColumn("kind", F.col("sid") % 3)
    return select6(spatial.area_share(tracts(t), z, "id", "sid", "kind", "pop", 1.0), "id", "kind")


@query(f"""WITH p AS (SELECT id, x, y, c_mktsegment AS n FROM {_PEOPLE}) SELECT a.id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.n = a.n AND b.id < a.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.1005)""")
def dedupe_places(t: Tables) -> DataFrame:
    return spatial.dedupe_places(people(t), "id", "c_mktsegment", 0.1005).select("id")


@query(f"""
WITH n AS (SELECT a.id, count(s.sid) AS n FROM {_AREAS} a LEFT JOIN {_SHOPS} s ON s.x >= x0 AND s.x < x0 + 1 AND s.y >= y0 AND s.y < y0 + 1 GROUP BY 1)
SELECT n.id, n.n AS n_points, pop, coalesce(pop, 0) >= 60 AND n.n < 4 AS gap FROM n JOIN {_TRACTS} t ON n.id = t.id""")
def gap_screen(t: Tables) -> DataFrame:
    n = spatial.count_within(areas(t), shops(t), "id", 1.0).join(tracts(t).select("id", "pop"), "id")
    return n.withColumn("gap", (F.coalesce("pop", F.lit(0.0)) >= 60) & (F.col("n_points") < 4))


@query(f"""SELECT sid, round(1.4 * 1.4, 6) AS area, round(5.6, 6) AS perimeter, round(x, 6) AS cx, round(y, 6) AS cy, round(x - 0.7, 6) AS xmin, true AS valid, true AS inside, round(0.5 * 64 * sin(2 * pi() / 64) * 0.25, 6) AS buffer_area FROM {_SHOPS}""")
def geometry_functions(t: Tables) -> DataFrame:
    z = zones(t).join(shops(t), "sid")
    outer = F.get("rings", F.lit(0))
    c = g.centroid(outer)
    buf = g.area(g.buffer(F.col("x"), F.col("y"), F.lit(0.5)))
    return z.select("sid", r6(g.area(F.col("rings")), "area"), r6(g.perimeter(F.col("rings")), "perimeter"), r6(c.x, "cx"), r6(c.y, "cy"), r6(g.bounds(F.col("rings")).xmin, "xmin"), g.is_valid(F.col("rings")).alias("valid"), g.contains(F.col("rings"), F.col("x"), F.col("y")).alias("inside"), r6(buf, "buffer_area"))


@query(f"""SELECT id, round(6378137.0 * radians(x), 3) AS mx, round(6378137.0 * ln(tan(pi() / 4 + radians(y) / 2)), 3) AS my, CAST(32600 + floor((x + 180) / 6) + 1 AS INTEGER) AS zone FROM {_PEOPLE}""")
def projections(t: Tables) -> DataFrame:
    p = people(t)
    mx, my = web_mercator(F.col("x"), F.col("y"))
    return p.select("id", F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"), utm_zone(F.col("x"), F.col("y")).alias("zone"))


@query()
def projection_utm(t: Tables) -> DataFrame:
    e, n = utm(F.col("x"), F.col("y"), utm_zone(F.col("x"), F.col("y")) % 100)
    return people(t).select("id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query(f"""
SELECT 'crs' AS "check", 'PASS' AS status, 0.0::DOUBLE AS value UNION ALL SELECT 'features', 'PASS', CAST(count(*) AS DOUBLE) FROM nation UNION ALL SELECT 'empty', 'PASS', 0 UNION ALL SELECT 'invalid', 'PASS', 0""")
def vector_checks(t: Tables) -> DataFrame:
    return quality.check_vector(areas(t).withColumn("srid", F.lit(4326)), 4326, 20).select("check", "status", "value")


_PAIRS = f"(SELECT a.id AS i, b.id AS j, 1.0::DOUBLE AS w, abs(a.x0 - b.x0) AS dx, abs(a.y0 - b.y0) AS dy FROM {_AREAS} a, {_AREAS} b WHERE a.id <> b.id)"
_QUEEN = f"(SELECT i, j, w FROM {_PAIRS} WHERE dx <= 1 AND dy <= 1)"
_ROOK = f"(SELECT i, j, w FROM {_PAIRS} WHERE dx + dy = 1)"


@query(f"SELECT * FROM {_QUEEN}")
def weights_queen(t: Tables) -> DataFrame:
    return stats.weights(areas(t), "queen")


@query(f"SELECT * FROM {_ROOK}")
def weights_rook(t: Tables) -> DataFrame:
    return stats.weights(areas(t), "rook")


@query(f"""WITH d AS (SELECT a.sid AS i, b.sid AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM {_SHOPS} a, {_SHOPS} b WHERE a.sid <> b.sid)
SELECT i, j, 1.0::DOUBLE AS w FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) r FROM d) WHERE r <= 5""")
def weights_knn(t: Tables) -> DataFrame:
    return stats.weights(shops(t).withColumnRenamed("sid", "id").withColumns({"x": F.col("x"), "y": F.col("y")}), "knn", k=5, distance=1.0)


def _y(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.sum("c_acctbal").alias("y"), F.count("*").cast("double").alias("n"))


_Y = "(SELECT CAST(c_nationkey AS BIGINT) id, sum(c_acctbal) y, CAST(count(*) AS DOUBLE) n FROM customer GROUP BY 1)"


def _p(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * (abs({z}) / sqrt(2))))"
    return f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-1 * pow(abs({z}) / sqrt(2), 2))"


@query(f"""
WITH z AS (SELECT id, y - avg(y) OVER () AS z, count(*) OVER () AS n, var_pop(y) OVER () AS v FROM {_Y}),
c AS (SELECT sum(w * a.z * b.z) AS c, sum(w) AS s0, any_value(a.n) AS n, any_value(a.v) AS v FROM {_QUEEN} q JOIN z a ON a.id = i JOIN z b ON b.id = j),
s1 AS (SELECT sum((2 * w) ** 2) / 2 AS s1 FROM {_QUEEN}), s2 AS (SELECT sum((2 * k) ** 2) AS s2 FROM (SELECT i, sum(w) k FROM {_QUEEN} GROUP BY 1)),
m AS (SELECT n, c / (s0 * v) AS moran_i, -1.0 / (n - 1) AS expected, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1.0) * s0 * s0) - 1.0 / ((n - 1) * (n - 1)) AS variance FROM c, s1, s2),
k AS (SELECT *, (moran_i - expected) / sqrt(variance) AS z FROM m), p AS (SELECT *, {_p('z')} AS p FROM k)
SELECT n, round(moran_i, 6) moran_i, round(expected, 6) expected, round(variance, 6) variance, round(z, 6) z, round(p, 6) p, CASE WHEN p >= 0.05 THEN 'random' WHEN moran_i > 0 THEN 'clustered' ELSE 'dispersed' END AS verdict FROM p""")
def morans_i(t: Tables) -> DataFrame:
    return select6(stats.morans_i(_y(t), stats.weights(areas(t), "queen"), "y"), "verdict")


@query(f"""
WITH q AS (SELECT i, j, w FROM {_QUEEN} UNION ALL SELECT id, id, 1 FROM {_Y}),
s AS (SELECT i, sum(w * y) wy, sum(w) w, sum(w * w) w2 FROM q JOIN {_Y} ON id = j GROUP BY 1),
m AS (SELECT avg(y) m, sqrt(var_pop(y)) s, count(*) n FROM {_Y}),
z AS (SELECT i AS id, (wy - m * w) / (s * sqrt((n * w2 - w * w) / (n - 1))) AS z FROM s, m), p AS (SELECT id, z, {_p('z')} AS p FROM z),
o AS (SELECT *, row_number() OVER (ORDER BY p) * 0.05 / count(*) OVER () AS bound, 0.05 / count(*) OVER () AS least FROM p), f AS (SELECT coalesce(max(bound) FILTER (WHERE p <= bound), max(least)) AS threshold FROM o)
SELECT id, round(z, 6) AS gi_z, round(p, 6) AS gi_p, CASE WHEN p > threshold OR abs(z) < 1.65 THEN 'Not Significant' ELSE CASE WHEN z > 0 THEN 'Hot Spot ' ELSE 'Cold Spot ' END || CASE WHEN abs(z) >= 2.58 THEN '(99%)' WHEN abs(z) >= 1.96 THEN '(95%)' ELSE '(90%)' END END AS tier FROM p, f""")
def gi_star(t: Tables) -> DataFrame:
    return select6(stats.hotspots(_y(t), stats.weights(areas(t), "queen"), "y").drop("threshold"), "id", "tier")


@query(f"""
WITH z AS (SELECT id, y - avg(y) OVER () AS z, count(*) OVER () AS n, var_pop(y) OVER () AS v FROM {_Y}), l AS (SELECT i, sum(w * z) AS lag FROM {_QUEEN} JOIN z ON id = j GROUP BY 1)
SELECT id, round((n - 1) * z * lag / (n * v), 6) AS local_i, CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 AND lag <= 0 THEN 3 ELSE 4 END AS quadrant FROM z JOIN l ON i = id""")
def lisa(t: Tables) -> DataFrame:
    return select6(stats.lisa(_y(t), stats.weights(areas(t), "queen"), "y"), "id")


@query("""
WITH p AS (SELECT l_tax / 0.09 * 0.2 + 0.0001 AS p FROM lineitem), r AS (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM p)
SELECT round(coalesce(max(i * 0.05 / n) FILTER (WHERE p <= i * 0.05 / n), any_value(0.05 / n)), 9) AS threshold FROM r""")
def fdr(t: Tables) -> DataFrame:
    p = t.lineitem.select((F.col("l_tax") / 0.09 * 0.2 + 0.0001).alias("p"))
    return stats.fdr_threshold(p, "p").select(F.round("threshold", 9).alias("threshold"))


@query()
def permutation_test(t: Tables) -> DataFrame:
    return stats.permutation_p(_y(t), stats.weights(areas(t), "queen"), "y", n=199)


@query("""
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem),
s AS (SELECT count(*) n, regr_slope(y, x) b1, regr_intercept(y, x) b0, regr_r2(y, x) r2, regr_syy(y, x) * (1 - regr_r2(y, x)) sse, regr_sxx(y, x) sxx, avg(x) mx FROM d)
SELECT 'intercept' AS term, round(b0, 4) AS coefficient, round(sqrt(sse / (n - 2) * (1.0 / n + mx * mx / sxx)), 4) AS std_error, round(r2, 6) AS r2, n FROM s UNION ALL
SELECT 'l_quantity', round(b1, 4), round(sqrt(sse / (n - 2) / sxx), 4), round(r2, 6), n FROM s""")
def ols_model(t: Tables) -> DataFrame:
    m = stats.ols_model(t.lineitem, "l_extendedprice", ["l_quantity"])
    return m.select("term", F.round("coefficient", 4).alias("coefficient"), F.round("std_error", 4).alias("std_error"), r6("r2"), "n")


@query()
def lm_diagnostics(t: Tables) -> DataFrame:
    w = stats.row_standardise(stats.weights(areas(t), "queen"))
    return select6(stats.lm_diagnostics(_y(t), w, "y", ["n"]), "test")


@query()
def model_choice(t: Tables) -> DataFrame:
    w = stats.row_standardise(stats.weights(areas(t), "queen"))
    return stats.choose_model(stats.lm_diagnostics(_y(t), w, "y", ["n"])).select("model")


@query()
def spatial_lag_model(t: Tables) -> DataFrame:
    w = stats.row_standardise(stats.weights(areas(t), "queen"))
    return select6(stats.spatial_lag_2sls(_y(t), w, "y", ["n"]), "term")


@query(f"""
WITH s AS (SELECT count(*) n, (stddev_pop(x) + stddev_pop(y)) / 2 * pow(count(*), -1.0 / 6) AS h, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM {_SHOPS}),
g AS (SELECT r AS row, c AS col, x0 - (x1 - x0) * 0.1 + c * ((x1 - x0) * 1.2 / 19) AS x, y0 - (y1 - y0) * 0.1 + r * ((y1 - y0) * 1.2 / 19) AS y, h, n FROM s, range(20) a(r), range(20) b(c)),
d AS (SELECT row, col, coalesce(sum(exp(-((g.x - s.x) ** 2 + (g.y - s.y) ** 2) / (2 * h * h))) FILTER (WHERE sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) <= 4 * h), 0) AS v FROM g, {_SHOPS} s GROUP BY 1, 2)
SELECT row, col, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 5) AS density FROM d""")
def kde_grid(t: Tables) -> DataFrame:
    return stats.kde(shops(t), 20).withColumn("density", F.round("density", 5))


def cells(t: Tables) -> DataFrame:
    """``part`` as a raster of 50 columns."""
    return t.part.select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.col("p_retailprice").alias("v"), F.col("p_size").cast("double").alias("b2"))


_CELLS = "(SELECT CAST(p_partkey // 50 AS BIGINT) AS row, p_partkey % 50 AS col, p_retailprice AS v, CAST(p_size AS DOUBLE) AS b2 FROM part)"


@query(f"SELECT row, col, round(least(greatest((v - b2) / (v + b2 + 1e-10), -1), 1), 6) AS v FROM {_CELLS}")
def raster_ndvi(t: Tables) -> DataFrame:
    return select6(raster.index(cells(t).withColumnsRenamed({"v": "nir", "b2": "red"}), "NDVI"), "row", "col")


@query(f"SELECT row, col, CASE WHEN b2 <> 10 THEN round(least(greatest(v / (b2 - 10), -50), 50), 6) END AS v FROM {_CELLS}")
def raster_calc(t: Tables) -> DataFrame:
    return select6(raster.raster_calc(cells(t), "try_divide(v, b2 - 10)", (-50.0, 50.0)), "row", "col")


@query(f"""
WITH c AS (SELECT row // 10 AS zone, b2 AS v FROM {_CELLS}), n AS (SELECT zone, v, count(*) c FROM c GROUP BY 1, 2)
SELECT zone, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, sum(v) AS sum, count(*) AS count, round(stddev_pop(v), 6) AS std, quantile_cont(v, 0.5) AS median, max(v) - min(v) AS range,
(SELECT v FROM n WHERE n.zone = c.zone ORDER BY n.c DESC, v LIMIT 1) AS majority, (SELECT v FROM n WHERE n.zone = c.zone ORDER BY n.c, v LIMIT 1) AS minority, count(DISTINCT v) AS "unique",
round(quantile_cont(v, 0.25), 6) AS percentile_25, round(quantile_cont(v, 0.75), 6) AS percentile_75, round(quantile_cont(v, 0.9), 6) AS percentile_90, round(quantile_cont(v, 0.95), 6) AS percentile_95 FROM c GROUP BY zone""")
def zonal_stats(t: Tables) -> DataFrame:
    c = cells(t)
    return select6(raster.zonal_stats(c.select("row", "col", F.col("b2").alias("v")), c.select("row", "col", F.floor(F.col("row") / 10).alias("zone")), "zone"), "zone")


_GRAD = f"""SELECT row, col, CASE WHEN lag(v) OVER r IS NULL THEN lead(v) OVER r - v WHEN lead(v) OVER r IS NULL THEN v - lag(v) OVER r ELSE (lead(v) OVER r - lag(v) OVER r) / 2 END AS gx,
CASE WHEN lag(v) OVER c IS NULL THEN lead(v) OVER c - v WHEN lead(v) OVER c IS NULL THEN v - lag(v) OVER c ELSE (lead(v) OVER c - lag(v) OVER c) / 2 END AS gy
FROM {_CELLS} WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row)"""


@query(f"""
WITH g AS ({_GRAD}), a AS (SELECT row, col, atan(sqrt(coalesce(gx, 0) ** 2 + coalesce(gy, 0) ** 2)) AS s, atan2(-coalesce(gx, 0), coalesce(gy, 0)) AS a FROM g)
SELECT row, col, round(degrees(s), 6) AS slope, round(least(greatest(sin(radians(45)) + 0 * s + (sin(radians(45)) * cos(s) - sin(radians(45))) + cos(radians(45)) * sin(s) * cos(radians(315) - a), 0), 1), 6) AS hillshade FROM a""")
def slope_aspect(t: Tables) -> DataFrame:
    return raster.terrain(cells(t).select("row", "col", "v")).select("row", "col", r6("slope"), r6("hillshade"))


_NINE = f"""(SELECT a.row, a.col, a.v AS z, b.v FROM {_CELLS} a, (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc), (SELECT max(row) mr, max(col) mc FROM {_CELLS}) e
JOIN {_CELLS} b ON b.row = least(greatest(a.row + dr, 0), mr) AND b.col = least(greatest(a.col + dc, 0), mc))"""


@query(f"SELECT row, col, round(sqrt(sum((v - z) ** 2)), 6) AS tri, round(any_value(z) - avg(v), 6) AS tpi, round(max(v) - min(v), 6) AS roughness FROM {_NINE} GROUP BY 1, 2")
def tri_tpi(t: Tables) -> DataFrame:
    return select6(raster.ruggedness(cells(t).select("row", "col", "v")), "row", "col")


@query(f"""
WITH n AS (SELECT a.row, a.col, (a.v - b.v) / (CASE WHEN dr * dc = 0 THEN 1 ELSE sqrt(2) END) AS drop, k, code FROM {_CELLS} a,
(VALUES (0, -1, 0, 64), (1, -1, 1, 128), (2, 0, 1, 1), (3, 1, 1, 2), (4, 1, 0, 4), (5, 1, -1, 8), (6, 0, -1, 16), (7, -1, -1, 32)) d(k, dr, dc, code) JOIN {_CELLS} b ON b.row = a.row + dr AND b.col = a.col + dc),
r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY drop DESC, k) AS i FROM n)
SELECT row, col, CASE WHEN drop > 0 THEN code ELSE 0 END AS dir FROM r WHERE i = 1""")
def d8(t: Tables) -> DataFrame:
    return raster.flow_direction(cells(t).select("row", "col", "v"))


@query(f"SELECT CAST(a AS INTEGER) AS from_class, CAST(b AS INTEGER) AS to_class, count(*) n FROM (SELECT floor(v / 200) AS a, floor(b2 / 10) AS b FROM {_CELLS}) GROUP BY 1, 2")
def change_matrix(t: Tables) -> DataFrame:
    c = cells(t)
    cut_ = lambda col, w: c.select("row", "col", F.floor(F.col(col) / w).cast("int").alias("v"))
    return raster.change_matrix(cut_("v", 200), cut_("b2", 10))


@query(f"SELECT row, col, v FROM {_CELLS} WHERE row BETWEEN 3 AND 12 AND col BETWEEN 5 AND 20")
def raster_clip(t: Tables) -> DataFrame:
    return raster.raster_clip(cells(t).select("row", "col", "v"), (3, 12), (5, 20))


@query(f"SELECT row, col, CASE WHEN b2 > 20 THEN b2 ELSE v END AS v FROM {_CELLS}")
def raster_mosaic(t: Tables) -> DataFrame:
    c = cells(t)
    return raster.mosaic([c.select("row", "col", F.when(F.col("b2") > 20, F.col("b2")).alias("v")), c.select("row", "col", "v")])


@query(f"""SELECT c.row, c.col, round(min(sqrt((c.row - f.row) ** 2 + (c.col - f.col) ** 2)), 6) AS d FROM {_CELLS} c, (SELECT row, col FROM {_CELLS} WHERE b2 = 1) f GROUP BY 1, 2""")
def raster_proximity(t: Tables) -> DataFrame:
    c = cells(t)
    return select6(raster.proximity(c, c.where("b2 = 1")), "row", "col")


@query(f"SELECT row // 2 AS row, col // 2 AS col, v FROM {_CELLS} WHERE row % 2 = 0 AND col % 2 = 0")
def raster_align(t: Tables) -> DataFrame:
    return raster.align(cells(t).select("row", "col", "v"), 2.0)


@query()
def contour_lengths(t: Tables) -> DataFrame:
    return raster.contours(cells(t).select("row", "col", "v"), 100.0).groupBy("level").agg(F.count("*").alias("segments"), r6(F.sum("length"), "length"))


@query(f"""
WITH k AS (SELECT d, exp(-d * d / 2.0) AS w FROM range(-4, 5) t(d)),
h AS (SELECT a.row, a.col, sum(b.v * w) / sum(w) AS v FROM {_CELLS} a CROSS JOIN k JOIN {_CELLS} b ON b.row = a.row AND b.col = a.col + d GROUP BY 1, 2)
SELECT a.row, a.col, round(sum(b.v * w) / sum(w), 6) AS v FROM h a CROSS JOIN k JOIN h b ON b.col = a.col AND b.row = a.row + d GROUP BY 1, 2""")
def smoothed(t: Tables) -> DataFrame:
    return select6(raster.smooth(cells(t).select("row", "col", "v")), "row", "col")


@query()
def filled_depressions(t: Tables) -> DataFrame:
    return raster.fill_depressions(cells(t).select("row", "col", "v"))


_FLOWS = f"""(SELECT row * 50 + col AS src, (row + dr) * 50 + col + dc AS dst FROM (SELECT a.row, a.col, dr, dc, (a.v - b.v) / (CASE WHEN dr * dc = 0 THEN 1 ELSE sqrt(2) END) AS drop,
 row_number() OVER (PARTITION BY a.row, a.col ORDER BY (a.v - b.v) / (CASE WHEN dr * dc = 0 THEN 1 ELSE sqrt(2) END) DESC, k) AS i FROM {_CELLS} a,
 (VALUES (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1)) d(k, dr, dc) JOIN {_CELLS} b ON b.row = a.row + dr AND b.col = a.col + dc) WHERE i = 1 AND drop > 0)"""


@query(f"""
WITH RECURSIVE f AS MATERIALIZED {_FLOWS}, w AS (SELECT row * 50 + col AS src, row * 50 + col AS cell FROM {_CELLS} UNION ALL SELECT w.src, f.dst FROM w JOIN f ON f.src = w.cell)
SELECT cell // 50 AS row, cell % 50 AS col, count(*) AS acc FROM w GROUP BY cell""")
def accumulation(t: Tables) -> DataFrame:
    return raster.flow_accumulation(raster.flow_direction(cells(t).select("row", "col", "v")))


@query()
def strahler(t: Tables) -> DataFrame:
    e = raster.flow_edges(raster.flow_direction(cells(t).select("row", "col", "v")))
    return raster.strahler(e.select((F.col("row") * 1000 + F.col("col")).alias("src"), (F.col("to_row") * 1000 + F.col("to_col")).alias("dst")))


def roads(t: Tables) -> DataFrame:
    """Both ways between side-by-side cells; minutes from the part size."""
    c = t.part.select(F.col("p_partkey").alias("src"), F.col("p_size").cast("double").alias("minutes"))
    n = t.part.count()
    right = c.where("src % 50 < 49").select("src", (F.col("src") + 1).alias("dst"), "minutes")
    down = c.select("src", (F.col("src") + 50).alias("dst"), "minutes")
    one = right.unionByName(down).where(F.col("dst") < n)
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "minutes"))


_ROADS = """(SELECT p_partkey AS src, p_partkey + 1 AS dst, p_size AS minutes FROM part WHERE p_partkey % 50 < 49 AND p_partkey + 1 < (SELECT count(*) FROM part)
 UNION ALL SELECT p_partkey + 1, p_partkey, p_size FROM part WHERE p_partkey % 50 < 49 AND p_partkey + 1 < (SELECT count(*) FROM part)
 UNION ALL SELECT p_partkey, p_partkey + 50, p_size FROM part WHERE p_partkey + 50 < (SELECT count(*) FROM part) UNION ALL SELECT p_partkey + 50, p_partkey, p_size FROM part WHERE p_partkey + 50 < (SELECT count(*) FROM part))"""


@query(f"""
WITH RECURSIVE e AS MATERIALIZED {_ROADS}, r AS (SELECT * FROM (VALUES (1, 10, 0), (2, 777, 0)) v(source, node, cost) UNION SELECT r.source, e.dst, r.cost + e.minutes FROM r JOIN e ON e.src = r.node WHERE r.cost + e.minutes <= 40)
SELECT CAST(source AS BIGINT) AS source, CAST(m AS DOUBLE) AS minutes, count(DISTINCT node) AS nodes FROM r, (VALUES (20), (40)) l(m) WHERE cost <= m GROUP BY source, m""")
def isochrones(t: Tables) -> DataFrame:
    return network.isochrones(roads(t), t.spark.createDataFrame([(1, 10), (2, 777)], "source long, node long"), [20.0, 40.0])


@query()
def nearest_facility(t: Tables) -> DataFrame:
    f = t.supplier.select(F.col("s_suppkey").alias("facility"), (F.col("s_suppkey") * 19).alias("node"))
    return network.nearest_facility(roads(t), t.part.select(F.col("p_partkey").alias("node")), f)


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS u, c_custkey + 1 AS v FROM customer WHERE c_custkey % 7 <> 0), c AS (SELECT c_custkey AS node, c_custkey - (c_custkey + 6) % 7 AS component FROM customer)
SELECT node, greatest(component, 0) AS component FROM c WHERE node IN (SELECT u FROM e UNION SELECT v FROM e) UNION SELECT max(v) AS node, greatest(max(v) - (max(v) + 6) % 7, 0) AS component FROM e""")
def connected(t: Tables) -> DataFrame:
    e = t.customer.where("c_custkey % 7 != 0").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"))
    return network.components(e)


@query()
def thinning(t: Tables) -> DataFrame:
    return rank.thin(people(t), "id", "x", "y", 0.3).select("id")


@query(f"SELECT min(x - 0.5) AS xmin, max(x + 0.5) AS xmax, count(*) AS n FROM {_SHOPS}")
def total_bounds(t: Tables) -> DataFrame:
    return spatial.with_bounds(zones(t, 0.5)).agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.count("*").alias("n"))


@query(f"SELECT round(100.0 * count(DISTINCT p.id) FILTER (WHERE a.id IS NOT NULL) / count(DISTINCT p.id), 2)::DOUBLE AS match_pct FROM {_PEOPLE} p LEFT JOIN (SELECT * FROM {_AREAS} WHERE id < 10) a ON p.x >= x0 AND p.x < x0 + 1 AND p.y >= y0 AND p.y < y0 + 1")
def match_stats(t: Tables) -> DataFrame:
    p = people(t)
    j = spatial.points_in(areas(t).where("id < 10").withColumnRenamed("id", "area"), p, 1.0).select("id", "area")
    return spatial.match_stats(p, j, "id", "area").select(F.col("match_pct").cast("double").alias("match_pct"))


@query(f"SELECT a_class, b_class, count(*) n FROM (SELECT CAST(ntile(5) OVER (ORDER BY y, id) AS INTEGER) a_class, CAST(ntile(5) OVER (ORDER BY n, id) AS INTEGER) b_class FROM {_Y}) GROUP BY 1, 2")
def quintile_crosstab(t: Tables) -> DataFrame:
    return profile.crosstab(_y(t), "y", "n", "id", 5)
