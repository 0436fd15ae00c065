"""Joins by place: features meet in grid cells, then an exact test decides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.operators.nearest import nearest_join
from arealis.operators.shapes import relations
from arealis.sources.shared import cut


def with_bounds(df: DataFrame, rings: str = "rings") -> DataFrame:
    return df.withColumn("_b", g.bounds(F.col(rings))).select("*", "_b.xmin", "_b.ymin", "_b.xmax", "_b.ymax").drop("_b")


def _cells(xmin: Column, ymin: Column, xmax: Column, ymax: Column, size: float) -> Column:
    """All grid cells that a box touches."""
    seq = lambda a, b: F.sequence(F.floor(a / size).cast("long"), F.floor(b / size).cast("long"))
    return F.flatten(F.transform(seq(xmin, xmax), lambda cx: F.transform(seq(ymin, ymax), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def near_pairs(left: DataFrame, right: DataFrame, distance: float, strict: bool = False) -> DataFrame:
    """Pairs of ``(…, x, y)`` and ``(…, x2, y2)`` within ``distance`` (below it with ``strict``), as ``d``.

    Left points look into the nine cells around theirs, right ones stand in one.
    """
    cell = lambda c: F.floor(F.col(c) / distance).cast("long")
    l = left.where("x is not null and y is not null").withColumn("_c", F.explode(_cells(F.col("x") - distance, F.col("y") - distance, F.col("x") + distance, F.col("y") + distance, distance)))
    r = right.where("x2 is not null and y2 is not null").withColumns({"_cx": cell("x2"), "_cy": cell("y2")})
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    # merged: packed files would make Spark send a side of any size to the driver
    out = l.join(r.hint("merge"), (F.col("_c.cx") == F.col("_cx")) & (F.col("_c.cy") == F.col("_cy"))).withColumn("d", d)
    return out.where(F.col("d") < distance if strict else F.col("d") <= distance).drop("_c", "_cx", "_cy")


def box_pairs(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of features whose boxes touch; right boxes are ``xmin2 …``.

    Both stand in all their cells; a pair is taken in the cell of its larger lower
    corners only, so it comes once.
    """
    a = left.withColumn("_c", F.explode(_cells(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), size)))
    b = right.withColumn("_d", F.explode(_cells(F.col("xmin2"), F.col("ymin2"), F.col("xmax2"), F.col("ymax2"), size)))
    out = a.join(b, (F.col("_c.cx") == F.col("_d.cx")) & (F.col("_c.cy") == F.col("_d.cy")))
    touch = (F.col("xmin") <= F.col("xmax2")) & (F.col("xmin2") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax2")) & (F.col("ymin2") <= F.col("ymax"))
    once = (F.floor(F.greatest("xmin", "xmin2") / size) == F.col("_c.cx")) & (F.floor(F.greatest("ymin", "ymin2") / size) == F.col("_c.cy"))
    return out.where(touch & once).drop("_c", "_d")


def points_in(polys: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """Pairs of polygons (``rings``) and points (``x, y``) inside them."""
    a = with_bounds(polys).withColumn("_c", F.explode(_cells(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), size)))
    p = points.where("x is not null and y is not null").withColumns({"_cx": F.floor(F.col("x") / size).cast("long"), "_cy": F.floor(F.col("y") / size).cast("long")})
    j = a.join(p, (F.col("_c.cx") == F.col("_cx")) & (F.col("_c.cy") == F.col("_cy")))
    return j.where(g.contains(F.col("rings"), F.col("x"), F.col("y"))).drop("_c", "_cx", "_cy", "xmin", "ymin", "xmax", "ymax")


def spatial_join(left: DataFrame, right: DataFrame, key: str, predicate: str = "intersects", how: str = "inner", size: float = 1.0, fields: Sequence[str] = (), right_key: str | None = None) -> DataFrame:
    """Join polygons (``rings``) or lines (``line``) with points (``x, y``), polygons (``rings2``) or lines (``line2``).

    Points on the right are taken where they are inside polygons. Otherwise polygons may
    have any shape, with holes and several parts, and ``predicate`` is one of
    ``intersects`` (any common point), ``contains``, ``within``, ``overlaps``,
    ``touches`` and ``crosses`` as in ``shapes.relations``, or ``interiors``: shapes that
    share more than their borders. ``how`` is inner, left or
    right; ``fields`` chooses right columns. ``right_key`` names a unique right column;
    without it right rows are written once with numbers, where pairs need them. Null and
    empty shapes match nothing; repeated right rows each match.
    """
    shape = next((c for c in ("rings2", "line2") if c in right.columns), None)
    if shape and predicate not in ("intersects", "contains", "within", "overlaps", "touches", "crosses", "interiors"):
        raise ValueError(f"shapes don't offer {predicate}")
    keep = [c for c in right.columns if c != shape]
    if shape or how == "right":
        r = right.withColumn("_rid", F.col(right_key)) if right_key else cut(right.withColumn("_rid", F.monotonically_increasing_id()), "right")
        if shape:
            own = "line" if "line" in left.columns else "rings"
            pairs = relations(left.select(F.col(key).alias("lid"), own), r.select(F.col("_rid").alias("rid"), F.col(shape).alias(shape[:-1])), size)
            pairs = pairs.where("intersects and not touches" if predicate == "interiors" else predicate).select(F.col("lid").alias(key), F.col("rid").alias("_rid"))
        else:
            pairs = points_in(left, r.select("_rid", "x", "y"), size).select(key, "_rid")
        if how == "right":
            out = r.join(pairs.join(left, key), "_rid", "left")
            return out.select(*left.columns, *(fields or keep))
        found = pairs.join(r, "_rid").select(key, *(fields or keep))
    else:
        found = points_in(left, right, size).select(key, *(fields or keep))
    return left.join(found, key, "left" if how == "left" else "inner")


def match_stats(left: DataFrame, joined: DataFrame, key: str, right_key: str) -> DataFrame:
    """Left rows matched, unmatched and the rate, each left row once."""
    m = joined.agg(F.count_distinct(F.when(F.col(right_key).isNotNull(), F.col(key))).alias("matched"))
    return m.join(left.agg(F.count_distinct(key).alias("n"))).select("matched", (F.col("n") - F.col("matched")).alias("unmatched"), F.round(100.0 * F.col("matched") / F.nullif(F.col("n"), F.lit(0)), 2).alias("match_pct"))


def count_within(polys: DataFrame, points: DataFrame, key: str, size: float) -> DataFrame:
    """Points in each polygon, 0 where none; a point in two polygons counts in both."""
    n = points_in(polys.select(key, "rings"), points.select("x", "y"), size).groupBy(key).agg(F.count("*").alias("n"))
    return polys.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_points"))


def _places(points: DataFrame) -> DataFrame:
    return points.select("x", "y").distinct()


def count_within_distance(left: DataFrame, right: DataFrame, key: str, distance: float) -> DataFrame:
    """Right points within ``distance`` of each left point, 0 where none.

    Pairs are made of different places, however many points stand in each.
    """
    r = right.groupBy(F.col("x").alias("x2"), F.col("y").alias("y2")).agg(F.count("*").alias("_m"))
    n = near_pairs(_places(left), r, distance).groupBy("x", "y").agg(F.sum("_m").alias("n"))
    return left.select(key, "x", "y").join(n, ["x", "y"], "left").select(key, F.coalesce("n", F.lit(0)).alias("n_within"))


def exclude_near(left: DataFrame, right: DataFrame, key: str, distance: float) -> DataFrame:
    """Left points without a right point nearer than ``distance``; pairs are made of different places."""
    near = near_pairs(_places(left), _places(right).select(F.col("x").alias("x2"), F.col("y").alias("y2")), distance, strict=True)
    return left.join(near.select("x", "y").distinct(), ["x", "y"], "left_anti").select(*left.columns)


def clip_points(points: DataFrame, area: DataFrame, key: str, size: float) -> DataFrame:
    return points.join(points_in(area.select("rings"), points.select(key, "x", "y"), size).select(key).distinct(), key, "left_semi")


def overlaps(zones: DataFrame, tracts: DataFrame, zone: str, tract: str, size: float) -> DataFrame:
    """``(zone, tract, frac)``: the share of each tract's area inside each convex zone.

    Equal zones are clipped once and share the result. Where both are upright boxes the
    product of their common sides is taken, which has no rounding beyond that of the sides.
    """
    shapes = _zone_boxes(zones.select("rings").distinct())
    pairs = box_pairs(with_bounds(tracts.select(tract, "rings", _upright(F.col("rings")).alias("_box"))), shapes, size)
    side = lambda k: F.greatest(F.least(f"{k}max2", f"{k}max") - F.greatest(f"{k}min2", f"{k}min"), F.lit(0.0))
    common = F.when(F.col("_box") & F.col("_box2"), side("x") * side("y")).otherwise(g.clip_area(F.col("rings"), F.get("_zr", F.lit(0))))
    frac = common / F.nullif(g.area(F.col("rings")), F.lit(0.0))
    found = pairs.select("_zr", tract, F.least(frac, F.lit(1.0)).alias("frac")).where("frac > 0")
    return zones.select(zone, F.col("rings").alias("_zr")).join(found, "_zr").select(zone, tract, "frac")


def _upright(rings: Column) -> Column:
    """Whether a polygon is one box with sides along the axes."""
    ring, b = F.get(rings, F.lit(0)), g.bounds(rings)
    corner = F.forall(ring, lambda p: ((p.x == b.xmin) | (p.x == b.xmax)) & ((p.y == b.ymin) | (p.y == b.ymax)))
    turn = F.forall(g.edges(ring), lambda e: (e.a.x == e.b.x) != (e.a.y == e.b.y))
    return F.coalesce((F.size(rings) == 1) & (F.size(ring) == 4) & (F.size(F.array_distinct(ring)) == 4) & corner & turn, F.lit(False))


def _zone_boxes(zones: DataFrame) -> DataFrame:
    b = zones.select(F.col("rings").alias("_zr"), g.bounds(F.col("rings")).alias("_zb"))
    return b.select("_zr", _upright(F.col("_zr")).alias("_box2"), *(F.col(f"_zb.{c}").alias(f"{c}2") for c in ("xmin", "ymin", "xmax", "ymax")))


def areal_weighted_mean(zones: DataFrame, tracts: DataFrame, zone: str, tract: str, variables: Sequence[str], size: float) -> DataFrame:
    """Means weighted by the share of each tract inside; zones that meet none keep nulls."""
    o = overlaps(zones, tracts, zone, tract, size).join(tracts.select(tract, *variables), tract)
    w = F.col("frac")
    aggs = [(F.sum(F.col(v) * w) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), w)), F.lit(0.0))).alias(v) for v in variables]
    return zones.select(zone).join(o.groupBy(zone).agg(*aggs, F.count("*").alias("n_tracts")), zone, "left").fillna(0, ["n_tracts"])


def apportion(zones: DataFrame, tracts: DataFrame, zone: str, tract: str, counts: Sequence[str], size: float, weighted: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """Counts shared out by area; ``weighted[column] = count`` are means weighted by the shared-out count."""
    o = overlaps(zones, tracts, zone, tract, size).join(tracts, tract)
    s = [F.sum(F.col(c) * F.col("frac")).alias(c) for c in counts]
    m = [(F.sum(F.col(v) * F.col(c) * F.col("frac")) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col(c) * F.col("frac"))), F.lit(0.0))).alias(v) for v, c in weighted.items()]
    return zones.select(zone).join(o.groupBy(zone).agg(*s, *m), zone, "left").fillna(0.0, list(counts))


def daytime_rings(rings: DataFrame, tracts: DataFrame, site: str, tract: str, count: str, employed: str, size: float) -> DataFrame:
    """``ring_demographics`` of residents with ``employed`` and ``daytime`` of each ring.

    A ring whose workers are more than 40% of its residents has 1.3 times the people by
    day; both are cut to whole people. Nulls count as 0.
    """
    t = tracts.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (count, employed)})
    people, work = (ring_demographics(rings, t, site, tract, c, size) for c in (count, employed))
    out = people.join(work.select(site, "ring", F.col("in_ring").alias("employed")), [site, "ring"])
    # The multiplier and the share.
    day = F.when(F.col("employed") > F.col("in_ring") * 0.4, F.col("in_ring") * 1.3).otherwise(F.col("in_ring"))
    return out.withColumn("daytime", F.floor(day + 1e-9).cast("long"))


def ring_demographics(rings: DataFrame, tracts: DataFrame, site: str, tract: str, count: str, size: float) -> DataFrame:
    """Counts between each ring of a site and the next smaller one, and up to it.

    ``rings(site, ring, rings)``: nested convex zones, numbered from the inside.
    """
    zones = rings.withColumn("_zone", F.struct(site, "ring"))
    inside = overlaps(zones, tracts, "_zone", tract, size).join(tracts.select(tract, count), tract)
    cum = inside.groupBy("_zone").agg(F.sum(F.col(count) * F.col("frac")).alias("cumulative"))
    cum = zones.select("_zone").join(cum, "_zone", "left").select(F.col(f"_zone.{site}").alias(site), F.col("_zone.ring").alias("ring"), F.coalesce("cumulative", F.lit(0.0)).alias("cumulative"))
    before = F.lag("cumulative", 1, 0.0).over(Window.partitionBy(site).orderBy("ring"))
    return cum.withColumn("in_ring", F.col("cumulative") - before)


def competitor_metrics(zones: DataFrame, competitors: DataFrame, zone: str, size: float, start: float) -> DataFrame:
    """Competitors per square unit inside each zone, and from its centroid to the nearest."""
    inside = count_within(zones, competitors, zone, size)
    c = g.centroid(F.get("rings", F.lit(0)))
    centres = zones.select(zone, c.alias("_c"), g.area(F.col("rings")).alias("area")).select(zone, "area", "_c.x", "_c.y")
    gap = nearest_join(centres, competitors.withColumn("_id", F.monotonically_increasing_id()), zone, "_id", start).groupBy(zone).agg(F.min("d").alias("gap"))
    return centres.join(inside, zone).join(gap, zone, "left").select(zone, F.bround(F.col("n_points") / F.col("area"), 4).alias("density"), F.bround("gap", 3).alias("gap"))


def weighted_centroid(zones: DataFrame, tracts: DataFrame, zone: str, tract: str, count: str, size: float) -> DataFrame:
    """The mean of tract centroids weighted by shared-out population, else the zone's own centroid."""
    t = tracts.select(tract, count, g.centroid(F.get("rings", F.lit(0))).alias("_t"))
    o = overlaps(zones, tracts, zone, tract, size).join(t, tract).withColumn("_w", F.col(count) * F.col("frac"))
    m = o.groupBy(zone).agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_t.x")).alias("_x"), F.sum(F.col("_w") * F.col("_t.y")).alias("_y"))
    own = g.centroid(F.get("rings", F.lit(0)))
    some = F.col("_w") > 0
    return zones.join(m, zone, "left").select(zone, F.when(some, F.col("_x") / F.col("_w")).otherwise(own.x).alias("x"), F.when(some, F.col("_y") / F.col("_w")).otherwise(own.y).alias("y"))


def band_profile(targets: DataFrame, layer: DataFrame, key: str, bands: Sequence[float], category: str, nested: bool = False) -> DataFrame:
    """Layer points by distance band and category around each target; bands may be nested.

    Points of one category in one place are counted first, targets in one place share
    the result, so pairs are made of different places.
    """
    r = layer.groupBy(F.col("x").alias("x2"), F.col("y").alias("y2"), category).agg(F.count("*").alias("_m"))
    pairs = near_pairs(_places(targets), r, max(bands))
    fits = F.array(*(F.when(F.col("d") <= b, F.lit(float(b))) for b in sorted(bands)))
    pairs = pairs.withColumn("band", F.explode(F.array_compact(fits))) if nested else pairs.withColumn("band", F.array_min(F.array_compact(fits)))
    n = pairs.groupBy("x", "y", "band", category).agg(F.sum("_m").alias("n"))
    return targets.select(key, "x", "y").join(n, ["x", "y"]).groupBy(key, "band", category).agg(F.sum("n").alias("n"))


def area_share(tracts: DataFrame, zones: DataFrame, tract: str, zone: str, kind: str, count: str, size: float) -> DataFrame:
    """Share of each tract inside the zones of each class, and the people in it."""
    o = overlaps(zones, tracts, zone, tract, size).join(zones.select(zone, kind), zone)
    s = o.groupBy(tract, kind).agg(F.least(F.sum("frac"), F.lit(1.0)).alias("share"))
    return s.join(tracts.select(tract, count), tract).select(tract, kind, "share", (F.col("share") * F.col(count)).alias("exposed"))


def dedupe_places(df: DataFrame, key: str, name: str, distance: float) -> DataFrame:
    """Of places with one name within ``distance`` of each other, those without a lower key."""
    a = df.select(F.col(key).alias("_k"), F.lower(name).alias("_n"), "x", "y")
    b = df.select(F.col(key).alias("_k2"), F.lower(name).alias("_n2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    lower = near_pairs(a, b, distance).where("_n = _n2 and _k2 < _k").select(F.col("_k").alias(key)).distinct()
    return df.join(lower, key, "left_anti")


def align_crs(df: DataFrame, srid: int, lon: str = "x", lat: str = "y") -> DataFrame:
    """Points in degrees projected to Web Mercator (3857) or a UTM zone; others must be in ``srid``."""
    from arealis.functions.columns import utm, web_mercator

    if srid == 3857:
        x, y = web_mercator(F.col(lon), F.col(lat))
    elif 32601 <= srid <= 32660 or 32701 <= srid <= 32760:
        x, y = utm(F.col(lon), F.col(lat), F.lit(srid % 100))
    else:
        raise ValueError(f"no projection to {srid}")
    here = F.col("srid") == srid
    return df.withColumns({"x": F.when(here, F.col("x")).otherwise(x), "y": F.when(here, F.col("y")).otherwise(y)}).withColumn("srid", F.lit(srid))
