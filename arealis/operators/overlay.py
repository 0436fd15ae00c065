"""Hulls, grid overlays, basins and persistent places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.operators.hulls import convex_hull  # noqa: F401  offered here as well
from arealis.operators.network import components
from arealis.operators.spatial import apportion


def grid_cells(df: DataFrame, cell: float, rings: str = "rings") -> DataFrame:
    """``(cx, cy)`` of grid cells whose centre lies in a polygon."""
    b = g.bounds(F.col(rings))
    seq = lambda a, z: F.sequence(F.floor(a / cell).cast("long"), F.floor(z / cell).cast("long"))
    cells = df.withColumn("_b", b).withColumn("cx", F.explode(seq(F.col("_b.xmin"), F.col("_b.xmax")))).withColumn("cy", F.explode(seq(F.col("_b.ymin"), F.col("_b.ymax"))))
    return cells.where(g.contains(F.col(rings), (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell)).select("cx", "cy").distinct()


def grid_overlay(area: DataFrame, cover: DataFrame, cell: float, min_area: float = 0.01) -> DataFrame:
    """Zones of ``area`` that ``cover`` leaves free: ``(zone, cells, area, x, y)``, slivers left out.

    Both become grid cells, free ones that share a side form a zone; exact to the cell.
    """
    free = grid_cells(area, cell).join(grid_cells(cover, cell), ["cx", "cy"], "left_anti")
    name = lambda x, y: x * (1 << 31) + y
    free = free.select("cx", "cy", name(F.col("cx"), F.col("cy")).alias("node"))
    step = F.explode(F.array(*(F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy")) for a, b in ((1, 0), (0, 1))))).alias("s")
    sides = free.select(F.col("node").alias("src"), step).select("src", "s.cx", "s.cy").join(free, ["cx", "cy"]).select("src", F.col("node").alias("dst"))
    zones = free.join(components(sides), "node", "left").withColumn("zone", F.coalesce("component", "node"))
    out = zones.groupBy("zone").agg(F.count("*").alias("cells"), (F.avg("cx") * cell + cell / 2).alias("x"), (F.avg("cy") * cell + cell / 2).alias("y"))
    return out.withColumn("area", F.col("cells") * (cell * cell)).where(F.col("area") >= min_area).select("zone", "cells", "area", "x", "y")


def validate_basin(basin: DataFrame, acc: DataFrame, row: int, col: int, expected_cells: float | None = None) -> DataFrame:
    """Checks of a catchment: it has cells, holds its pour point in one piece, and drains what it should."""
    cells = basin.select("row", "col").distinct().withColumn("node", F.col("row") * (1 << 20) + F.col("col"))
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("m")
    near = cells.select(F.col("node").alias("src"), "row", "col", moves).select("src", (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"))
    pieces = cells.join(components(near.join(cells.hint("merge"), ["row", "col"]).select("src", F.col("node").alias("dst"))).hint("merge"), "node", "left")
    at = (F.col("row") == row) & (F.col("col") == col)
    one = pieces.agg(F.count("*").alias("n"), F.count_if(at).alias("inside"), F.count_distinct(F.coalesce("component", "node")).alias("parts"))
    one = one.join(acc.where(at).agg(F.max("acc").alias("acc")))
    expected = F.lit(expected_cells) if expected_cells else F.col("n").cast("double")
    checks = {"cells": F.col("n") > 0, "pour_point": F.col("inside") == 1, "connected": F.col("parts") == 1, "accumulation": F.col("acc") == F.col("n"), "area": F.col("n").between(expected / 2, expected * 2)}
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.when(F.coalesce(v, F.lit(False)), "PASS").otherwise("FAIL").alias("status")) for k, v in checks.items()))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def persistent(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Places that are hot spots in both vintages."""
    hot = lambda d: d.where(F.col("tier").startswith("Hot")).select(key)
    return hot(a).join(hot(b).hint("merge"), key)


def population_near(points: DataFrame, tracts: DataFrame, key: str, tract: str, count: str, radius: float, size: float, n: int = 64) -> DataFrame:
    """People within ``radius`` of each point, shared out by the area of a regular ``n``-gon."""
    zones = points.select(key, g.buffer(F.col("x"), F.col("y"), F.lit(float(radius)), n).alias("rings"))
    return apportion(zones, tracts, key, tract, [count], size)
