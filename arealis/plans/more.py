"""Further queries: overlays, basins, catalogs, layers and file formats, over data derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.operators import catalog, classify, clean, joins, overlay, quality, rank, raster, rates, spatial, stats
from arealis.plans.places import _AREAS, _PEOPLE, _SHOPS, areas, cells, people, shops, tracts, zones
from arealis.plans.registry import Tables, query, r6, select6
from arealis.sources import payloads, tables
from arealis.sources.shared import cut, shared_dir


def _scratch(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query()
def convex_hulls(t: Tables) -> DataFrame:
    h = overlay.convex_hull(people(t), "c_mktsegment")
    return h.select("c_mktsegment", F.size(F.get("rings", F.lit(0))).alias("corners"), r6(g.area(F.col("rings")), "area"))


@query()
def white_space(t: Tables) -> DataFrame:
    return select6(overlay.grid_overlay(areas(t), zones(t, 0.2), 0.1), "zone", "cells")


@query()
def population_near(t: Tables) -> DataFrame:
    return select6(overlay.population_near(shops(t), tracts(t), "sid", "id", "pop", 0.6, 1.0), "sid")


@query()
def persistent_hot_spots(t: Tables) -> DataFrame:
    """Cells that are hot by price as well as by price and size together."""
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    c = cells(t).select((F.col("row") * 50 + F.col("col")).alias("id"), "v", "b2", g.box(x, y, x + 1, y + 1).alias("rings"))
    w = cut(stats.weights(c, "queen"))  # both vintages read it
    first, second = c.select("id", F.col("v").alias("y")), c.select("id", (F.col("v") + 4 * F.col("b2")).alias("y"))
    return overlay.persistent(stats.hotspots(first, w, "y"), stats.hotspots(second, w, "y"), "id")


@query()
def catchment(t: Tables) -> DataFrame:
    d = raster.flow_direction(cells(t).select("row", "col", "v"))
    acc = raster.flow_accumulation(d)
    outlet = acc.orderBy(F.desc("acc"), "row", "col").first()
    return overlay.validate_basin(raster.catchment(d, outlet.row, outlet.col), acc, outlet.row, outlet.col)


@query()
def stream_lengths(t: Tables) -> DataFrame:
    d = raster.flow_direction(cells(t).select("row", "col", "v"))
    s = raster.streams(raster.flow_accumulation(d), d, 0.2)
    e = s.select((F.col("row") * 1000 + F.col("col")).alias("src"), (F.col("to_row") * 1000 + F.col("to_col")).alias("dst"), F.hypot(F.col("row") - F.col("to_row"), F.col("col") - F.col("to_col")).alias("length"))
    return select6(raster.stream_stats(e, raster.strahler(e), 2000.0), "ord", "n")


@query("SELECT id, CAST(round_even(pop / 10, 0) AS BIGINT) AS dots FROM (SELECT CAST(c_nationkey AS BIGINT) AS id, count(*) AS pop FROM customer GROUP BY 1) WHERE round_even(pop / 10, 0) > 0")
def dot_density(t: Tables) -> DataFrame:
    """Dots that fall inside their area: all that were asked for."""
    a = areas(t).join(tracts(t).select("id", "pop"), "id")
    d = classify.dots_inside(a, "pop", 10.0, "id", seed=7).join(a, "id")
    return d.where(g.contains(F.col("rings"), F.col("x"), F.col("y"))).groupBy("id").agg(F.count("*").alias("dots"))


@query(f"SELECT id, CAST(round_even(pop / 10, 0) AS BIGINT) AS dots FROM (SELECT c_nationkey AS id, count(*) AS pop FROM customer GROUP BY 1) WHERE round_even(pop / 10, 0) > 0")
def dot_counts(t: Tables) -> DataFrame:
    a = spatial.with_bounds(areas(t)).join(tracts(t).select("id", "pop"), "id")
    return classify.dots(a, "pop", 10.0, "id").groupBy(F.col("id").cast("int").alias("id")).agg(F.count("*").alias("dots"))


@query("SELECT c_custkey, regexp_matches(lower(c_name), 'university|college|prison|correctional|penitentiary|military|air force|fort|naval|army|marine|hospital|reservation') OR c_acctbal > 60 AS institutional FROM customer")
def institutional_flags(t: Tables) -> DataFrame:
    return clean.flag_institutional(t.customer, "c_name", "c_acctbal").select("c_custkey", "institutional")


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS context FROM l)
SELECT doc_id, CAST(n AS INTEGER) AS n, md5(context) AS context FROM c WHERE contains(lower(line), 'license')""")
def context_lines(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    out = rank.context(lines, "doc_id", "n", "line", F.lower("line").contains("license"))
    return out.select("doc_id", "n", F.md5("context").alias("context"))


@query("""SELECT p_partkey, round((p_size + p_retailprice) / 2, 6) AS burden, round(p_size / 1.0, 6) AS need, round((p_size + p_retailprice) / 2 * p_size, 6) AS composite FROM part""")
def composite_index(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    return rates.composite_index(p, {"burden": ["s", "r"], "need": ["s"]}).select("p_partkey", r6("burden"), r6("need"), r6("composite"))


@query("""SELECT 'a' || (o_orderkey % 50) AS node, 'input' AS kind FROM orders UNION SELECT 'b' || (o_orderkey % 50), 'intermediate' FROM orders UNION SELECT 'c' || (o_orderkey % 50), 'output' FROM orders UNION
SELECT 's' || (o_orderkey % 50), 'operation' FROM orders UNION SELECT 't' || (o_orderkey % 50), 'operation' FROM orders""")
def lineage_nodes(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 50
    part = lambda p: F.concat(F.lit(p), k.cast("string"))
    one = t.orders.select(part("s").alias("step"), F.array(part("a")).alias("inputs"), F.array(part("b")).alias("outputs"))
    two = t.orders.select(part("t").alias("step"), F.array(part("b")).alias("inputs"), F.array(part("c")).alias("outputs"))
    return catalog.lineage(one.unionByName(two).distinct())[0]


@query("""SELECT 'd/' || page_id || '.tif' AS path, CAST(page_id AS VARCHAR) AS stem, page_id % 2 = 0 AS has_manifest, CASE WHEN page_id % 3 = 0 THEN page_id END AS inspected_rows FROM pages""")
def asset_inventory(t: Tables) -> DataFrame:
    p = t.pages
    path = lambda suffix: F.concat(F.lit("d/"), F.col("page_id").cast("string"), F.lit(suffix)).alias("path")
    return catalog.inventory(p.select(path(".tif")), p.where("page_id % 2 = 0").select(path(".json")), p.where("page_id % 3 = 0").select(path(".txt"), F.col("page_id").alias("rows")))


@query("SELECT c_name, c_nationkey FROM customer WHERE c_nationkey = 1 AND c_name IS NOT NULL")
def facet_filter(t: Tables) -> DataFrame:
    return catalog.facet_filter(t.customer, c_nationkey=1, c_name=True).select("c_name", "c_nationkey")


@query("SELECT CAST(n_nationkey AS VARCHAR) k, n_name, CAST(NULL AS DOUBLE) AS bal FROM nation UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, s_acctbal FROM supplier")
def union_layers(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    return joins.union_layers([a, t.supplier.select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_acctbal").alias("bal"))])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) r FROM orders) WHERE r = 1")
def latest_order(t: Tables) -> DataFrame:
    return joins.latest(t.orders, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS geoid, c_mktsegment FROM customer")
def csv_round_trip(t: Tables) -> DataFrame:
    path = _scratch(t, "table") + ".csv"
    tables.write_table(t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("geoid"), "c_mktsegment"), path)
    return tables.read_table(t.spark, path, as_string=True)


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def json_round_trip(t: Tables) -> DataFrame:
    path = _scratch(t, "table") + ".jsonl"
    tables.write_table(t.supplier.select("s_suppkey", "s_acctbal"), path)
    return tables.read_table(t.spark, path, schema="s_suppkey long, s_acctbal double")


@query(f"SELECT p.id FROM {_PEOPLE} p WHERE c_mktsegment = 'BUILDING' AND x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 3")
def places_by_box(t: Tables) -> DataFrame:
    path = _scratch(t, "places")
    box = F.struct(F.col("x").alias("xmin"), F.col("x").alias("xmax"), F.col("y").alias("ymin"), F.col("y").alias("ymax"))
    people(t).select("id", box.alias("bbox"), F.lit("people").alias("theme"), F.col("c_mktsegment").alias("type")).write.partitionBy("theme", "type").parquet(path)
    return tables.read_places(t.spark, path, "people", "BUILDING", (1, 1, 2, 3)).select("id")


@query(f"SELECT layer, count(*) AS n FROM (SELECT CASE WHEN sid % 2 = 0 THEN 'r1' ELSE 'r2' END AS layer FROM {_SHOPS}) GROUP BY 1")
def layered_output(t: Tables) -> DataFrame:
    path = _scratch(t, "layers")
    tables.write_layers(shops(t).withColumn("layer", F.when(F.col("sid") % 2 == 0, "r1").otherwise("r2")), path)
    return t.spark.read.parquet(path).groupBy("layer").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS \"rows\", 3 AS columns, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM " + _SHOPS)
def inspect_layer(t: Tables) -> DataFrame:
    return tables.inspect(shops(t)).drop("types")


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS w_geocode, c_nationkey::BIGINT AS \"C000\" FROM customer")
def job_files(t: Tables) -> DataFrame:
    path = _scratch(t, "wac")
    t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("w_geocode"), F.col("c_nationkey").alias("C000")).write.csv(path, header=True, compression="gzip")
    return payloads.read_lodes(t.spark, path, "wac")


@query("""SELECT array_to_string(list_sort(list(DISTINCT r_name)), '; ') AS agencies, (SELECT count(*) FROM nation) AS routes, (SELECT count(*) FROM supplier) AS stops,
(SELECT min(strftime(o_orderdate, '%Y%m%d')) FROM orders) AS first_day, (SELECT max(strftime(o_orderdate, '%Y%m%d')) FROM orders) AS last_day FROM region""")
def transit_summary(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return payloads.gtfs_stats(t.region.withColumnRenamed("r_name", "agency_name"), t.nation, t.supplier, t.orders.select(day.alias("start_date"), day.alias("end_date")))


@query("""SELECT field, type FROM (VALUES ('numeric:o_totalprice', 'PASS'), ('numeric:o_orderstatus', 'FAIL')) v(field, type)""")
def numeric_checks(t: Tables) -> DataFrame:
    return quality.check_numeric(t.orders, ["o_totalprice", "o_orderstatus"]).select(F.col("check").alias("field"), F.col("status").alias("type"))


@query("""
WITH v AS (SELECT c_acctbal v FROM customer UNION ALL SELECT s_acctbal FROM supplier), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM v),
b AS (SELECT DISTINCT v FROM r, (SELECT unnest(range(0, 5)) AS k) WHERE i = least(n * k // 4, n - 1)) SELECT v AS edge FROM b""")
def shared_breaks(t: Tables) -> DataFrame:
    e = classify.shared_breaks([t.customer.withColumnRenamed("c_acctbal", "v"), t.supplier.withColumnRenamed("s_acctbal", "v")], ["v"], 4)
    return t.spark.createDataFrame([(x,) for x in e], "edge double")


@query(f"SELECT id, round(x + 0.25, 3) AS x, true AS inside FROM {_PEOPLE}")
def surface_points(t: Tables) -> DataFrame:
    outer, x, y = F.get("rings", F.lit(0)), F.col("x"), F.col("y")
    p = people(t).select("id", g.box(x, y, x + 0.5, y + 0.5).alias("rings")).select("id", "rings", g.point_on_surface(outer).alias("p"))
    return p.select("id", F.round("p.x", 3).alias("x"), g.contains(F.col("rings"), F.col("p.x"), F.col("p.y")).alias("inside"))
