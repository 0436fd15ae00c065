"""Queries over concave polygons, lines, unions and free space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.operators import shapes, spatial
from arealis.plans.places import _AREAS, _SHOPS, areas, shops, zones
from arealis.plans.registry import Tables, query, r6, select6


def frames(t: Tables) -> DataFrame:
    """Around each shop a box of side 1.2 with a hole of side 0.4, less its upper right quarter."""
    x, y = F.col("x"), F.col("y")
    outer = F.array(*(g.point(x + a, y + b) for a, b in ((-0.6, -0.6), (0.6, -0.6), (0.6, 0.0), (0.0, 0.0), (0.0, 0.6), (-0.6, 0.6))))
    hole = F.array(*(g.point(x + a, y + b) for a, b in ((-0.5, -0.5), (-0.1, -0.5), (-0.1, -0.1), (-0.5, -0.1))))
    return shops(t).select("sid", F.array(outer, hole).alias("rings"))


def _part(a: float, b: float, c: float, d: float) -> str:
    return f"greatest(least(x + {c}, x0 + 1) - greatest(x + {a}, x0), 0) * greatest(least(y + {d}, y0 + 1) - greatest(y + {b}, y0), 0)"


_COMMON = f"({_part(-0.6, -0.6, 0.6, 0.0)} + {_part(-0.6, 0.0, 0.0, 0.6)} - {_part(-0.5, -0.5, -0.1, -0.1)})"


@query(f"SELECT sid, id, round({_COMMON}, 6) AS common FROM {_SHOPS} s, {_AREAS} a WHERE {_COMMON} > 1e-9")
def concave_common_area(t: Tables) -> DataFrame:
    out = shapes.common_area(areas(t), frames(t), "id", "sid", 1.0).where("common > 1e-9")
    return out.select("sid", "id", r6("common"))


@query(f"SELECT sid, id FROM {_SHOPS} s, {_AREAS} a WHERE {_COMMON} > 1e-9 AND {_COMMON} < 0.92 - 1e-9")
def concave_overlaps(t: Tables) -> DataFrame:
    return spatial.spatial_join(areas(t), frames(t).withColumnRenamed("rings", "rings2"), "id", "overlaps", right_key="sid").select("sid", "id")


def paths(t: Tables) -> DataFrame:
    """From each shop half a unit east, then half a unit north."""
    x, y = F.col("x"), F.col("y")
    return shops(t).select("sid", F.array(g.point(x, y), g.point(x + 0.5, y), g.point(x + 0.5, y + 0.5)).alias("line"))


# of the two legs of a path: the share inside the open box, and what is outside the closed one
_IN = "(y > y0 AND y < y0 + 1 AND x < x0 + 1 AND x + 0.5 > x0 OR x + 0.5 > x0 AND x + 0.5 < x0 + 1 AND y < y0 + 1 AND y + 0.5 > y0)"
_OUT = "(x < x0 OR x + 0.5 > x0 + 1 OR y < y0 OR y + 0.5 > y0 + 1)"


@query(f"SELECT id, sid FROM {_SHOPS} s, {_AREAS} a WHERE {_IN} AND {_OUT}")
def lines_cross_areas(t: Tables) -> DataFrame:
    return spatial.spatial_join(areas(t), paths(t).withColumnRenamed("line", "line2"), "id", "crosses", right_key="sid").select("id", "sid")


_LEGS = f"(SELECT sid, x, y, x + 0.5 AS x1, y + 0.5 AS y1 FROM {_SHOPS})"
# east leg of one path over the north leg of the other, in points that are no end of either path
_CROSS = "({0}.y > {1}.y AND {0}.y < {1}.y1 AND {1}.x1 > {0}.x AND {1}.x1 <= {0}.x1 OR {0}.y = {1}.y AND {1}.x1 > {0}.x AND {1}.x1 < {0}.x1 AND false)"


@query(f"SELECT a.sid, b.sid AS other FROM {_LEGS} a, {_LEGS} b WHERE a.sid < b.sid AND ({_CROSS.format('a', 'b')} OR {_CROSS.format('b', 'a')}) AND NOT (a.y = b.y AND a.x < b.x1 AND b.x < a.x1) AND NOT (a.x1 = b.x1 AND a.y < b.y1 AND b.y < a.y1)")
def lines_cross_lines(t: Tables) -> DataFrame:
    other = paths(t).select(F.col("sid").alias("other"), F.col("line").alias("line2"))
    return spatial.spatial_join(paths(t), other, "sid", "crosses", right_key="other").where("sid < other").select("sid", "other")


_BOXES = f"(SELECT x - 0.2 AS l, x + 0.2 AS r, y - 0.2 AS b, y + 0.2 AS u FROM {_SHOPS})"


@query(f"""
WITH z AS MATERIALIZED {_BOXES}, xs AS (SELECT DISTINCT v FROM (SELECT l AS v FROM z UNION ALL SELECT r FROM z UNION ALL SELECT unnest(range(6))) WHERE v BETWEEN 0 AND 5),
ys AS (SELECT DISTINCT v FROM (SELECT b AS v FROM z UNION ALL SELECT u FROM z UNION ALL SELECT unnest(range(6))) WHERE v BETWEEN 0 AND 5),
c AS (SELECT v AS x, lead(v) OVER (ORDER BY v) AS x1 FROM xs), d AS (SELECT v AS y, lead(v) OVER (ORDER BY v) AS y1 FROM ys),
f AS (SELECT (x + x1) / 2 AS mx, (y + y1) / 2 AS my, (x1 - x) * (y1 - y) AS area FROM c, d WHERE x1 IS NOT NULL AND y1 IS NOT NULL)
SELECT a.id, round(sum(f.area), 6) AS free FROM {_AREAS} a JOIN f ON mx > x0 AND mx < x0 + 1 AND my > y0 AND my < y0 + 1
WHERE NOT EXISTS (SELECT 1 FROM z WHERE mx > l AND mx < r AND my > b AND my < u) GROUP BY a.id""")
def free_area(t: Tables) -> DataFrame:
    """What no box of side 0.4 around a shop covers of each area, exactly."""
    p = shapes.uncovered(areas(t), zones(t, 0.2), ["id"], 0.5)
    return select6(p.groupBy("id").agg(F.sum(g.ring_area(F.col("piece"))).alias("free")), "id")


@query()
def free_zones(t: Tables) -> DataFrame:
    """Connected zones of what those boxes leave free."""
    z = shapes.zones_of(shapes.uncovered(areas(t), zones(t, 0.2), [], 0.5), 0.5)
    return z.select(r6("area"), r6("x"), r6("y"))
