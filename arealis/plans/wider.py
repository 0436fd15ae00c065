"""Queries over shares, groups of areas, polygon masks and further join predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.operators import classify, rank, raster, rates, spatial, stats
from arealis.plans.places import _AREAS, _CELLS, _QUEEN, _SHOPS, _TRACTS, _frac, areas, cells, shops, tracts, zones
from arealis.plans.registry import Tables, query, r6, select6


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS zone_id FROM customer WHERE c_acctbal >= 1000")
def renumbered_zones(t: Tables) -> DataFrame:
    return rank.renumber(t.customer.where("c_acctbal >= 1000"), "c_custkey").select("c_custkey", F.col("zone_id").cast("long").alias("zone_id"))


@query("""SELECT o_custkey, round(100.0 * count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) / count(*), 6) AS pct, CASE WHEN o_custkey % 7 > 0 THEN round(count(*)::DOUBLE / (o_custkey % 7), 6) END AS density FROM orders GROUP BY 1""")
def share_and_density(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count("*").alias("n"))
    out = rates.share_of_parts(n.withColumn("area", F.col("o_custkey") % 7), ["f", "p", "absent"], "n", "pct")
    return select6(rates.density(out, "n", "area", "density").select("o_custkey", "pct", "density"), "o_custkey")


@query(f"""
WITH y AS (SELECT c_mktsegment AS project, c_nationkey AS id, avg(c_acctbal) AS y FROM customer GROUP BY 1, 2), z AS (SELECT *, y - avg(y) OVER (PARTITION BY project) AS z FROM y),
w AS (SELECT a.project, a.z * b.z AS zz, 1.0 / count(*) OVER (PARTITION BY a.project, q.i) AS w FROM {_QUEEN} q JOIN z a ON a.id = q.i JOIN z b ON b.id = q.j AND b.project = a.project),
n AS (SELECT project, count(*) AS n, sum(z * z) AS zz FROM z GROUP BY 1), s AS (SELECT project, sum(w * zz) AS c, sum(w) AS s0 FROM w GROUP BY 1)
SELECT n.project, n.n, CASE WHEN n.n >= 10 THEN round(n.n / s0 * c / n.zz, 6) END AS moran_i, CASE WHEN n.n >= 10 THEN round(-1.0 / (n.n - 1), 6) END AS expected FROM n LEFT JOIN s USING (project)""")
def moran_by_project(t: Tables) -> DataFrame:
    y = t.customer.groupBy(F.col("c_mktsegment").alias("project"), F.col("c_nationkey").cast("long").alias("id")).agg(F.avg("c_acctbal").alias("y"))
    return stats.morans_by(y, stats.weights(areas(t), "queen"), "y", "project").select("project", "n", r6("moran_i"), r6("expected"))


@query()
def breaks_natural(t: Tables) -> DataFrame:
    e = classify.natural_breaks(t.orders, "o_totalprice", 5)
    return t.spark.createDataFrame([(i, x) for i, x in enumerate(e)], "place int, edge double")


_DIAMOND = "abs(col + 0.5 - 4 * s.x) + abs(row + 0.5 - 4 * s.y) < 1.3705"


def _diamonds(t: Tables) -> DataFrame:
    x, y, r = 4 * F.col("x"), 4 * F.col("y"), 1.3705
    return shops(t).select(F.array(F.array(g.point(x - r, y), g.point(x, y - r), g.point(x + r, y), g.point(x, y + r))).alias("rings"))


@query(f"SELECT row, col, v FROM {_CELLS} c WHERE EXISTS (SELECT 1 FROM {_SHOPS} s WHERE {_DIAMOND})")
def raster_clip_polygons(t: Tables) -> DataFrame:
    return raster.clip_by_polygons(cells(t).select("row", "col", "v"), _diamonds(t))


@query(f"SELECT row, col, v FROM {_CELLS} c WHERE EXISTS (SELECT 1 FROM {_SHOPS} s WHERE greatest(col - 4 * s.x, 4 * s.x - col - 1, 0) + greatest(row - 4 * s.y, 4 * s.y - row - 1, 0) < 1.3705)")
def raster_clip_touched(t: Tables) -> DataFrame:
    return raster.clip_by_polygons(cells(t).select("row", "col", "v"), _diamonds(t), all_touched=True)


@query(f"SELECT sid, id FROM {_SHOPS} z JOIN {_AREAS} a ON {_frac(0.45)} > 1e-6 AND NOT (x - 0.45 >= x0 AND x + 0.45 <= x0 + 1 AND y - 0.45 >= y0 AND y + 0.45 <= y0 + 1)")
def polygons_overlap(t: Tables) -> DataFrame:
    return spatial.spatial_join(zones(t, 0.45), areas(t).select("id", F.col("rings").alias("rings2")), "sid", "overlaps").select("sid", "id")


def _halves(t: Tables) -> DataFrame:
    """Boxes of side 0.5 on a grid of 0.5 from every shop's place."""
    x, y = F.floor(F.col("x") * 2) / 2, F.floor(F.col("y") * 2) / 2
    return shops(t).select("sid", g.box(x, y, x + 0.5, y + 0.5).alias("rings"))


@query(f"WITH h AS (SELECT sid, floor(x * 2) / 2 AS hx, floor(y * 2) / 2 AS hy FROM {_SHOPS}) SELECT sid, id FROM h JOIN {_AREAS} a ON hx <= x0 + 1 AND hx + 0.5 >= x0 AND hy <= y0 + 1 AND hy + 0.5 >= y0 AND NOT (hx < x0 + 1 AND hx + 0.5 > x0 AND hy < y0 + 1 AND hy + 0.5 > y0)")
def polygons_touch(t: Tables) -> DataFrame:
    return spatial.spatial_join(_halves(t), areas(t).select("id", F.col("rings").alias("rings2")), "sid", "touches").select("sid", "id")


@query(f"SELECT sid, id FROM {_SHOPS} z JOIN {_AREAS} a ON x - 0.45 >= x0 AND x + 0.45 <= x0 + 1 AND y - 0.45 >= y0 AND y + 0.45 <= y0 + 1")
def polygons_within(t: Tables) -> DataFrame:
    return spatial.spatial_join(zones(t, 0.45), areas(t).select("id", F.col("rings").alias("rings2")), "sid", "within").select("sid", "id")


@query(f"SELECT a.id, s.sid, s.x FROM {_SHOPS} s LEFT JOIN (SELECT * FROM {_AREAS} WHERE id < 10) a ON s.x >= x0 AND s.x < x0 + 1 AND s.y >= y0 AND s.y < y0 + 1")
def right_join_points(t: Tables) -> DataFrame:
    """Every shop, with the area it is in where the layer has one."""
    layer = areas(t).where("id < 10")
    return spatial.spatial_join(layer, shops(t), "id", "contains", "right").select("id", "sid", "x")


@query(f"""
WITH z AS (SELECT sid, pop, floor(pop * (0.2 + a.id % 5 * 0.1)) AS emp, {_frac(0.4)} AS f1, {_frac(0.9)} AS f2 FROM {_SHOPS} z, {_TRACTS} a),
s AS (SELECT sid, coalesce(sum(pop * f1), 0) p1, coalesce(sum(pop * f2), 0) - coalesce(sum(pop * f1), 0) p2, coalesce(sum(emp * f1), 0) e1, coalesce(sum(emp * f2), 0) - coalesce(sum(emp * f1), 0) e2 FROM z GROUP BY 1),
r AS (SELECT sid, 1 AS ring, p1 AS p, e1 AS e FROM s UNION ALL SELECT sid, 2, p2, e2 FROM s)
SELECT sid, ring, round(p, 6) AS in_ring, round(e, 6) AS employed, CAST(floor(CASE WHEN e > p * 0.4 THEN p * 1.3 ELSE p END + 1e-9) AS BIGINT) AS daytime FROM r""")
def ring_daytime(t: Tables) -> DataFrame:
    rings = zones(t, 0.4).withColumn("ring", F.lit(1)).unionByName(zones(t, 0.9).withColumn("ring", F.lit(2)))
    emp = tracts(t).withColumn("emp", F.floor(F.col("pop") * (F.lit(0.2) + F.col("id") % 5 * F.lit(0.1))))
    out = spatial.daytime_rings(rings, emp, "sid", "id", "pop", "emp", 1.0)
    return out.select("sid", "ring", r6("in_ring"), r6("employed"), "daytime")


@query("""
WITH b AS (SELECT p_partkey, p_size / 50.0 AS nir, p_retailprice / 2500 AS red, p_partkey % 10 / 10.0 AS blue, p_partkey % 7 / 7.0 AS green, p_partkey % 11 / 11.0 AS swir FROM part),
v AS (SELECT p_partkey, unnest([{'k': 'EVI', 'v': greatest(least((2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1 + 1e-10))::DOUBLE, 1), -1)}, {'k': 'SAVI', 'v': greatest(least(1.5 * (nir - red) / (nir + red + 0.5 + 1e-10), 1.5), -1.5)}, {'k': 'NDWI', 'v': greatest(least((green - nir) / (green + nir + 1e-10), 1), -1)}, {'k': 'NDBI', 'v': greatest(least((swir - nir) / (swir + nir + 1e-10), 1), -1)}]) AS e FROM b)
SELECT p_partkey AS row, e.k AS name, round(e.v, 6) AS v FROM v""")
def raster_indices(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    bands = t.part.select(k.alias("row"), F.lit(0).alias("col"), (F.col("p_size") / 50.0).alias("nir"), (F.col("p_retailprice") / 2500).alias("red"), (k % 10 / 10.0).alias("blue"), (k % 7 / 7.0).alias("green"), (k % 11 / 11.0).alias("swir"))
    out = None
    for name in ("EVI", "SAVI", "NDWI", "NDBI"):
        one = raster.index(bands, name).select("row", F.lit(name).alias("name"), r6("v"))
        out = one if out is None else out.unionByName(one)
    return out
