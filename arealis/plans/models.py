"""Queries over models, permutations, reach areas, the layer registry and the run log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.operators import lag_model, local_tests, network, raster, stats, stitch
from arealis.plans.places import _PEOPLE, _SHOPS, _y, areas, cells, people, roads, shops
from arealis.plans.registry import Tables, query, r6, select6
from arealis.sources.registry import LayerRegistry, RunLog
from arealis.sources.shared import shared_dir


@query()
def spatial_lag_likelihood(t: Tables) -> DataFrame:
    w = stats.row_standardise(stats.weights(areas(t), "queen"))
    return select6(lag_model.spatial_lag_ml(_y(t), w, "y", ["n"]), "term", "n")


def _cell_values(t: Tables) -> tuple[DataFrame, DataFrame]:
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    c = cells(t).select((F.col("row") * 50 + F.col("col")).alias("id"), "v", x.alias("x"), y.alias("y"))
    return c.select("id", F.col("v").alias("y")), stats.weights(c, "distance", distance=1.0)


@query()
def local_moran_p(t: Tables) -> DataFrame:
    v, w = _cell_values(t)
    return select6(local_tests.permutation_p(v, w, "y", "moran"), "id")


@query()
def local_gi_p(t: Tables) -> DataFrame:
    v, w = _cell_values(t)
    return select6(local_tests.permutation_p(v, w, "y", "gi_star"), "id")


def _reached(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 50 * 1000).cast("double").alias("x"), (F.floor(F.col("p_partkey") / 50) * 1000).cast("double").alias("y"))
    sources = t.supplier.select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") * 19).alias("node"))
    return network.isochrone_areas(roads(t), nodes, sources, [10.0, 20.0])


@query()
def isochrone_areas(t: Tables) -> DataFrame:
    """What each supplier reaches within 10 and 20 minutes, as a hull's area."""
    return _reached(t).select("source", "minutes", "nodes", r6("area_km2"))


@query()
def isochrone_unions(t: Tables) -> DataFrame:
    return select6(network.dissolved_isochrones(_reached(t), 4000.0), "minutes", "facilities")


@query(f"""SELECT 'people' AS name, 'point' AS geometry_type, count(*) AS n, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, 'all of them' AS note FROM {_PEOPLE}
UNION ALL SELECT 'shops', 'point', count(*), min(x), min(y), max(x), max(y), NULL FROM {_SHOPS} UNION ALL SELECT 'orders', 'table', count(*), NULL, NULL, NULL, NULL, NULL FROM orders""")
def layer_registry(t: Tables) -> DataFrame:
    """What the registry says after layers were added, replaced, removed and compacted."""
    r = LayerRegistry(t.spark, f"{shared_dir(t.spark)}/layers-{uuid.uuid4().hex}")
    r.register("people", people(t).where("id % 2 = 0"))
    r.register("shops", shops(t))
    r.register("nations", t.nation)
    r.register("people", people(t), "all of them")
    r.remove("nations")
    r.compact()
    r.register("orders", t.orders)
    return r.layers().select("name", "geometry_type", "n", "xmin", "ymin", "xmax", "ymax", "note")


@query("""SELECT 'read' AS step, count(*) AS rows, CAST(count(*) - count(l_shipdate) AS BIGINT) AS null_dates FROM lineitem
UNION ALL SELECT 'returned', count(*), CAST(count(*) - count(l_shipdate) AS BIGINT) FROM lineitem WHERE l_returnflag = 'R'""")
def run_log(t: Tables) -> DataFrame:
    """Rows and nulls of two steps, logged as one pass over the table ends."""
    log = RunLog(t.spark, f"{shared_dir(t.spark)}/runs-{uuid.uuid4().hex}")
    read = log.watch(t.lineitem, "read")
    log.watch(read.where("l_returnflag = 'R'"), "returned").write.format("noop").mode("overwrite").save()
    log.close()
    return log.rows().select("step", "rows", F.col("nulls")["l_shipdate"].alias("null_dates"))


@query()
def contour_lines(t: Tables) -> DataFrame:
    """Contour lines by level: closed ones, all of them, and their length."""
    lines = stitch.line_lengths(raster.contours(cells(t).select("row", "col", F.col("b2").alias("v")), 12.5))
    return select6(lines.groupBy("level").agg(F.count_if("closed").alias("rings"), F.count("*").alias("lines"), F.sum("length").alias("length")), "level", "rings", "lines")
