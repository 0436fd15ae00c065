"""Geometry as column expressions over arrays of points.

A ring is ``array<struct<x,y>>``, closed or not; a polygon part is an array of rings, the
first one outside, the others holes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A polygon part that is a rectangle."""
    return F.array(F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax)))


def buffer(x: Column, y: Column, r: Column, n: int = 64) -> Column:
    """A regular ``n``-gon inside the circle of radius ``r``."""
    steps = F.array(*(F.struct(F.lit(math.cos(2 * math.pi * k / n)).alias("c"), F.lit(math.sin(2 * math.pi * k / n)).alias("s")) for k in range(n)))
    return F.array(F.transform(steps, lambda a: F.struct((x + r * a.c).alias("x"), (y + r * a.s).alias("y"))))


def edges(ring: Column) -> Column:
    """Pairs ``(a, b)`` of neighbours, the last with the first."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + f(e))


def ring_area(ring: Column) -> Column:
    """Signed; positive when counter-clockwise."""
    return _sum(edges(ring), lambda e: e.a.x * e.b.y - e.b.x * e.a.y) / 2


def area(rings: Column) -> Column:
    """The outer ring less its holes."""
    return F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, 1.0).otherwise(-1.0) * F.abs(ring_area(r))), F.lit(0.0), lambda a, v: a + v)


def length(pts: Column) -> Column:
    """Of an open line."""
    open_ = F.slice(edges(pts), 1, F.greatest(F.size(pts) - 1, F.lit(0)))
    return _sum(open_, lambda e: F.hypot(e.b.x - e.a.x, e.b.y - e.a.y))


def perimeter(rings: Column) -> Column:
    return _sum(F.flatten(F.transform(rings, edges)), lambda e: F.hypot(e.b.x - e.a.x, e.b.y - e.a.y))


def centroid(ring: Column) -> Column:
    """Of the area of one ring."""
    cross = lambda e: e.a.x * e.b.y - e.b.x * e.a.y
    six = 6 * ring_area(ring)
    return point(_sum(edges(ring), lambda e: (e.a.x + e.b.x) * cross(e)) / six, _sum(edges(ring), lambda e: (e.a.y + e.b.y) * cross(e)) / six)


def bounds(rings: Column) -> Column:
    xs, ys = F.transform(F.flatten(rings), lambda p: p.x), F.transform(F.flatten(rings), lambda p: p.y)
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings: a point in a hole is outside; left and lower edges belong to a box."""
    crossed = lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < (e.b.x - e.a.x) * (y - e.a.y) / (e.b.y - e.a.y) + e.a.x)
    return F.size(F.filter(F.flatten(F.transform(rings, edges)), crossed)) % 2 == 1


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    """From a point to the segment ``a b``."""
    dx, dy = b.x - a.x, b.y - a.y
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a.x) * dx + (y - a.y) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))))
    t = F.coalesce(t, F.lit(0.0))
    return F.hypot(x - (a.x + t * dx), y - (a.y + t * dy))


def half_plane(ring: Column, a: Column, b: Column) -> Column:
    """The part of ``ring`` on the left of the line from ``a`` to ``b``."""
    side = lambda p: (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)
    marked = F.transform(ring, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), side(p).alias("s")))

    def part(e: Column) -> Column:
        t = e.a.s / (e.a.s - e.b.s)
        cross = point(e.a.x + t * (e.b.x - e.a.x), e.a.y + t * (e.b.y - e.a.y))
        here = F.array(point(e.a.x, e.a.y))
        none = F.slice(here, 1, 0)
        return F.when((e.a.s >= 0) & (e.b.s >= 0), here).when(e.a.s >= 0, F.concat(here, F.array(cross))).when(e.b.s >= 0, F.array(cross)).otherwise(none)

    return F.flatten(F.transform(edges(marked), part))


def clip(ring: Column, convex: Column) -> Column:
    """The part of ``ring`` inside a convex counter-clockwise ring (Sutherland and Hodgman 1974)."""
    return F.aggregate(edges(convex), ring, lambda subject, c: half_plane(subject, c.a, c.b))


def convex_minus(ring: Column, convex: Column, least: float = 1e-12) -> Column:
    """Disjoint convex rings that make up a convex ring less another one; parts below ``least`` are left out.

    Each edge cuts off what lies outside it; what is left goes to the next edge. Both
    rings are counter-clockwise and have no corner twice.
    """
    none = F.slice(F.array(ring), 1, 0)

    def cut(state: Column, e: Column) -> Column:
        outside = F.array_distinct(half_plane(state.rest, e.b, e.a))
        kept = F.when((F.size(outside) >= 3) & (ring_area(outside) > least), F.concat(state.out, F.array(outside))).otherwise(state.out)
        return F.struct(F.array_distinct(half_plane(state.rest, e.a, e.b)).alias("rest"), kept.alias("out"))

    cutting = F.aggregate(edges(convex), F.struct(ring.alias("rest"), none.alias("out")), cut)
    apart = clip_area(F.array(ring), convex) <= least
    return F.when(apart, F.array(ring)).otherwise(cutting.out)


def minus_all(pieces: Column, others: Column) -> Column:
    """Disjoint convex rings less an array of convex rings."""
    return F.aggregate(others, pieces, lambda left, o: F.flatten(F.transform(left, lambda p: convex_minus(p, o))))


def in_convex(convex: Column, x: Column, y: Column, slack: float = 1e-9) -> Column:
    """Whether a point lies in a convex counter-clockwise ring or on its edge, within ``slack``."""
    return F.forall(edges(convex), lambda e: (e.b.x - e.a.x) * (y - e.a.y) - (e.b.y - e.a.y) * (x - e.a.x) >= -slack * F.hypot(e.b.x - e.a.x, e.b.y - e.a.y))


def clip_area(rings: Column, convex: Column) -> Column:
    """Area of a polygon inside a convex ring; holes are clipped like the rest and taken off."""
    parts = F.transform(rings, lambda r, i: F.when(i == 0, 1.0).otherwise(-1.0) * F.abs(ring_area(clip(r, convex))))
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def difference_area(rings: Column, outer: Column, inner: Column) -> Column:
    """Area of a polygon in a convex ring but not in a smaller one inside that."""
    return F.greatest(clip_area(rings, outer) - clip_area(rings, inner), F.lit(0.0))


def _once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once for a row; a plain expression is repeated wherever ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def point_on_surface(ring: Column) -> Column:
    """The middle of the first inner stretch of a scan line through the middle of the box."""

    def on_line(r: Column, y: Column) -> Column:
        hits = F.filter(edges(r), lambda e: (e.a.y > y) != (e.b.y > y))
        xs = F.array_sort(F.transform(hits, lambda e: (e.b.x - e.a.x) * (y - e.a.y) / (e.b.y - e.a.y) + e.a.x))
        return _once(xs, lambda xs: F.when(F.size(xs) >= 2, point((F.get(xs, F.lit(0)) + F.get(xs, F.lit(1))) / 2, y)))

    middle = lambda b: (b.ymin + b.ymax) / 2 + (b.ymax - b.ymin) * F.lit(1e-9)
    return _once(ring, lambda r: _once(_once(bounds(F.array(r)), middle), lambda y: on_line(r, y)))


def is_valid(rings: Column) -> Column:
    """Rings of three points or more with an area, none of whose edges cross."""

    def turns(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x))

    def crosses(e: Column, f: Column) -> Column:
        return (turns(e.a, e.b, f.a) * turns(e.a, e.b, f.b) < 0) & (turns(f.a, f.b, e.a) * turns(f.a, f.b, e.b) < 0)

    simple = lambda r: ~F.exists(edges(r), lambda e: F.exists(edges(r), lambda f: crosses(e, f)))
    return F.coalesce(F.forall(rings, lambda r: (F.size(r) >= 3) & (ring_area(r) != 0) & simple(r)), F.lit(False))


def meet(rings: Column, other: Column) -> Column:
    """Whether a corner of one polygon is on an edge of the other."""

    def on(p: Column, e: Column) -> Column:
        cross = (e.b.x - e.a.x) * (p.y - e.a.y) - (e.b.y - e.a.y) * (p.x - e.a.x)
        dot = (p.x - e.a.x) * (p.x - e.b.x) + (p.y - e.a.y) * (p.y - e.b.y)
        return (F.abs(cross) <= 1e-12) & (dot <= 1e-12)

    def corner(of: Column, lines: Column) -> Column:
        return F.exists(F.flatten(of), lambda p: F.exists(F.flatten(F.transform(lines, edges)), lambda e: on(p, e)))

    return corner(rings, other) | corner(other, rings)
