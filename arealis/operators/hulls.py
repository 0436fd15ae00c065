"""Convex hulls of groups of points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """One side of a hull of sorted points (Andrew 1979)."""
    out: list[tuple[float, float]] = []
    for p in points:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
            out.pop()
        out.append(p)
    return out[:-1]


def _hull(x: list[float], y: list[float]) -> list[dict[str, float]]:
    pts = sorted(set(zip(x, y)))
    ring = pts if len(pts) < 3 else _chain(pts) + _chain(pts[::-1])
    return [{"x": a, "y": b} for a, b in ring]


def convex_hull(df: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """``(key, rings)``: the hull of each group's points (``x, y``); groups under three points have none.

    Hulls of parts come first, so what meets in a task is the corners of ``parts`` hulls
    and not all points of a group.
    """
    ring = "array<struct<x:double,y:double>>"

    def hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "ring": [_hull(list(x), list(y)) for x, y in zip(b["xs"], b["ys"])]})

    schema = f"{key} {dict(df.dtypes)[key]}, ring {ring}"
    pts = df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(key, "x", "y").distinct()
    for by in ([key, F.pmod(F.xxhash64("x", "y"), F.lit(parts))], [key]):
        lists = pts.groupBy(*by).agg(F.collect_list(F.struct("x", "y")).alias("p"))
        rings = lists.select(key, F.col("p.x").alias("xs"), F.col("p.y").alias("ys")).mapInPandas(hulls, schema)
        pts = rings.select(key, F.explode("ring").alias("p")).select(key, "p.x", "p.y")
    return rings.where(F.size("ring") >= 3).select(key, F.array("ring").alias("rings"))
