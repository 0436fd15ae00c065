"""Queries over single helpers: prefixes, limits, islands, snapping, profiles by area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.operators import clean, network, profile, rank, spatial, stats
from arealis.plans.places import _AREAS, _PEOPLE, _QUEEN, _SHOPS, areas, people, shops
from arealis.plans.registry import Tables, query, r6, select6


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS geoid, c_acctbal FROM customer WHERE lpad(CAST(c_custkey AS VARCHAR), 6, '0') LIKE '0001%'")
def id_prefix(t: Tables) -> DataFrame:
    ids = t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("geoid"), "c_acctbal")
    return clean.with_prefix(ids, "geoid", "0001")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 25")
def lowest_prices(t: Tables) -> DataFrame:
    return rank.top_n(t.part, "p_retailprice", 25, "p_partkey", ascending=True).select("p_partkey", "p_retailprice")


@query(f"SELECT id FROM {_AREAS} a WHERE id IN (SELECT i FROM {_QUEEN} WHERE i % 7 < 2 AND j % 7 < 2)")
def islands_dropped(t: Tables) -> DataFrame:
    w = stats.weights(areas(t).where("id % 7 < 2"), "queen")
    return stats.drop_islands(areas(t), w).select("id")


@query(f"""
WITH n AS (SELECT p_partkey AS node, (p_partkey % 50) / 10.0 AS nx, (p_partkey // 50) / 10.0 AS ny FROM part),
d AS (SELECT sid, node, sqrt((x - nx) ** 2 + (y - ny) ** 2) AS d FROM {_SHOPS}, n),
m AS (SELECT *, min(round(d, 9)) OVER (PARTITION BY sid) AS low FROM d)
SELECT sid, min(node) AS node, round(min(d), 6) AS d FROM m WHERE round(d, 9) = low GROUP BY sid""")
def snapped(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    nodes = t.part.select(k.alias("node"), (k % 50 / 10.0).alias("x"), (F.floor(k / 50) / 10.0).alias("y"))
    return network.snap(shops(t), nodes, "sid", "node", 1.0).select("sid", "node", r6("d"))


@query(f"""
SELECT a.id, CAST(isodow(o_orderdate) - 1 AS VARCHAR) AS bucket, count(*) AS events, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, round(count(*) / count(DISTINCT CAST(o_orderdate AS DATE)), 6) AS per_day
FROM orders JOIN {_PEOPLE} p ON p.id = o_custkey JOIN {_AREAS} a ON p.x >= x0 AND p.x < x0 + 1 AND p.y >= y0 AND p.y < y0 + 1 GROUP BY 1, 2""")
def weekday_by_area(t: Tables) -> DataFrame:
    """Orders by weekday in the area where the customer lives."""
    at = spatial.points_in(areas(t), people(t).select(F.col("id").alias("person"), "x", "y"), 1.0).select("id", "person")
    orders = t.orders.join(at, F.col("o_custkey") == F.col("person"))
    return select6(profile.temporal_profile(orders, "o_orderdate", "weekday", by=["id"]), "id", "bucket")


@query(f"SELECT id, CAST(count(*) FILTER (WHERE id % 3 > 0) OVER () AS BIGINT) AS kept FROM {_AREAS} QUALIFY id % 3 > 0")
def empty_shapes_dropped(t: Tables) -> DataFrame:
    """Areas of which every third has no shape."""
    a = areas(t).withColumn("rings", F.when(F.col("id") % 3 > 0, F.col("rings")))
    kept = clean.drop_empty_geom(a)
    return kept.join(F.broadcast(kept.agg(F.count("*").alias("kept")))).select("id", "kept")
