"""Nearest points by a quad-tree over the right side, however unevenly it lies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.sources.shared import cut

#: Points that a cell may hold before its quarters are looked at instead.
CAP = 64


def _cell(v: Column, low: float, side: float, level: Column) -> Column:
    """The column or row of a place at a level, inside the square."""
    n = F.pow(F.lit(2.0), level)
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((v - low) / side * n))).cast("long")


def nearest_join(left: DataFrame, right: DataFrame, key: str, right_key: str, start: float | None = None, max_distance: float | None = None, k: int = 1) -> DataFrame:
    """``(key, right_key, d)``: the nearest right points of each left point; equally near ones all stay.

    Right points are counted in squares of all sizes, each with four quarters. A left
    point starts from the smallest square around it that holds ``k`` points, whose far
    corner bounds the distance; squares of that size within the bound are its candidates.
    The bound sinks to the far corner of the nearest squares with ``k`` points in all,
    squares beyond it go, and those with more than ``CAP`` points are replaced by their
    quarters, until none is left. So a left point meets a few squares of up to ``CAP``
    points each in dense and in empty places; rounds grow with the logarithm of how
    uneven the points lie. ``start`` is not needed and kept for callers that name a first
    distance. Points without a place match nothing; no right points give no rows; more
    than ``CAP`` points in one place stay together.
    """
    r = right.select(F.col(right_key).alias("_rk"), F.col("x").cast("double").alias("x2"), F.col("y").cast("double").alias("y2")).where("x2 is not null and y2 is not null")
    l = left.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    e = r.agg(F.min("x2").alias("x"), F.min("y2").alias("y"), F.greatest(F.max("x2") - F.min("x2"), F.max("y2") - F.min("y2")).alias("side"), F.count("*").alias("n")).first()
    if not e.n:
        return l.join(r, F.lit(False)).select(key, F.col("_rk").alias(right_key), F.lit(0.0).alias("d"))
    side = (e.side or 1.0) * (1 + 1e-9)
    deep = min(20, max(0, math.ceil(math.log2(e.n / CAP) / 2)) + 5) if e.n > CAP else 0
    fine = lambda c, low: _cell(F.col(c), low, side, F.lit(deep))
    r = r.withColumns({"fx": fine("x2", e.x), "fy": fine("y2", e.y)})
    cells = cut(r.groupBy("fx", "fy").agg(F.count("*").alias("n")))
    up = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deep)))).withColumns({c: F.call_function("shiftright", F.col(f), (F.lit(deep) - F.col("level")).cast("int")) for c, f in (("cx", "fx"), ("cy", "fy"))})
    counts = cut(up.groupBy("level", "cx", "cy").agg(F.sum("n").alias("n")))
    # of each path the first square that is small enough has all its points
    small = (F.col("total") <= CAP) | (F.col("level") == deep)
    leaf = cut(up.drop("n").join(counts.withColumnRenamed("n", "total"), ["level", "cx", "cy"]).where(small).groupBy("fx", "fy").agg(F.min("level").alias("leaf")))
    of = up.drop("n").join(leaf, ["fx", "fy"]).where("level >= leaf").groupBy("level", "cx", "cy").agg(F.min("leaf").alias("leaf"))
    nodes = cut(counts.join(of, ["level", "cx", "cy"], "left"))
    shift = lambda c, by: F.call_function("shiftright", c, by.cast("int"))
    leaf_cell = lambda c: shift(F.col(c), F.lit(deep) - F.col("leaf"))
    r = r.join(leaf, ["fx", "fy"]).select("_rk", "x2", "y2", "leaf", leaf_cell("fx").alias("lx"), leaf_cell("fy").alias("ly"))

    width = lambda level: F.lit(side) / F.pow(F.lit(2.0), level)
    low = {"x": F.lit(e.x), "y": F.lit(e.y)}

    def near(axis: str) -> Column:
        a = low[axis] + F.col(f"c{axis}") * width(F.col("level"))
        return F.greatest(a - F.col(axis), F.col(axis) - a - width(F.col("level")), F.lit(0.0))

    def far(axis: str) -> Column:
        a = low[axis] + F.col(f"c{axis}") * width(F.col("level"))
        return F.greatest(F.abs(F.col(axis) - a), F.abs(F.col(axis) - a - width(F.col("level"))))

    slack = side * 1e-9
    most, least = F.hypot(far("x"), far("y")) + slack, F.hypot(near("x"), near("y")) - slack
    limit = F.lit(float(max_distance) if max_distance is not None else math.inf)
    inside = F.col("x").between(e.x, e.x + side) & F.col("y").between(e.y, e.y + side)
    l = l.withColumn("level", F.explode(F.when(inside, F.sequence(F.lit(0), F.lit(deep))).otherwise(F.array(F.lit(0)))))
    l = l.withColumns({"cx": _cell(F.col("x"), e.x, side, F.col("level")), "cy": _cell(F.col("y"), e.y, side, F.col("level"))})
    begun = l.join(counts.where((F.col("n") >= k) | (F.col("level") == 0)).drop("n"), ["level", "cx", "cy"]).withColumn("bound", most)
    begun = begun.groupBy(key, "x", "y").agg(F.max(F.struct("level", "bound")).alias("s")).select(key, "x", "y", "s.level", F.when(F.lit(e.n < k), F.lit(math.inf)).otherwise(F.col("s.bound")).alias("bound")).withColumn("bound", F.least("bound", limit))
    reach = lambda c: F.sequence(_cell(F.col(c) - F.col("bound"), getattr(e, c), side, F.col("level")), _cell(F.col(c) + F.col("bound"), getattr(e, c), side, F.col("level")))
    todo = begun.withColumn("cx", F.explode(reach("x"))).withColumn("cy", F.explode(reach("y"))).drop("bound")
    done = None
    while True:
        # the bound is the far corner by which the nearest squares hold k points
        c = todo.join(nodes, ["level", "cx", "cy"]).withColumns({"far": most, "near": least})
        by_far = F.array_sort(F.collect_list(F.struct("far", "n", "level", "cx", "cy", "leaf", "near")))
        c = c.groupBy(key, "x", "y").agg(by_far.alias("c"))
        got = F.aggregate("c", F.struct(F.lit(0).cast("long").alias("n"), F.lit(math.inf).alias("b")), lambda a, v: F.struct((a.n + v.n).alias("n"), F.when((a.n < k) & (a.n + v.n >= k), v.far).otherwise(a.b).alias("b")))
        c = c.withColumn("bound", F.least(got.b, limit)).select(key, "x", "y", F.explode(F.filter("c", lambda v: v.near <= F.col("bound"))).alias("v")).select(key, "x", "y", "v.*")
        c = cut(c.select(key, "x", "y", "level", "cx", "cy", "leaf"))
        ends = c.where("leaf is not null").select(key, "x", "y", "leaf", shift(F.col("cx"), F.col("level") - F.col("leaf")).alias("lx"), shift(F.col("cy"), F.col("level") - F.col("leaf")).alias("ly"))
        open_ = c.where("leaf is null")
        if open_.isEmpty():
            done = ends if done is None else done.unionByName(ends)
            break
        # points that still have open squares keep their closed ones beside the quarters, for the bound
        waiting = open_.select(key).distinct()
        over = ends.join(waiting, key, "left_anti")
        done = over if done is None else done.unionByName(over)
        quarter = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("q")
        split = open_.select(key, "x", "y", (F.col("level") + 1).alias("level"), "cx", "cy", quarter).select(key, "x", "y", "level", (2 * F.col("cx") + F.col("q.i")).alias("cx"), (2 * F.col("cy") + F.col("q.j")).alias("cy"))
        todo = split.unionByName(c.where("leaf is not null").join(waiting, key, "left_semi").select(key, "x", "y", "level", "cx", "cy"))
    pairs = done.distinct().join(r, ["leaf", "lx", "ly"]).withColumn("d", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).where(F.col("d") <= limit)
    placed = pairs.withColumn("_n", F.rank().over(Window.partitionBy(key).orderBy(F.round("d", 9))))
    return placed.where(F.col("_n") <= k).select(key, F.col("_rk").alias(right_key), "d")
