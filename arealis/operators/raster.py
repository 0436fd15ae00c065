"""Rasters as cell tables ``(row, col, v)``; no data is null."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.operators.flow import catchment_of, fill_depressions, strahler  # noqa: F401  offered here as well
from arealis.operators.spatial import box_pairs, nearest_join, points_in, with_bounds
from arealis.sources.shared import cut

# Eight neighbours in tie order with their direction codes.
D8 = [(-1, 0, 64), (-1, 1, 128), (0, 1, 1), (1, 1, 2), (1, 0, 4), (1, -1, 8), (0, -1, 16), (-1, -1, 32)]
# Presets over the bands NIR, RED, GREEN, BLUE, SWIR.
PRESETS = {
    "NDVI": "(nir - red) / (nir + red + 1e-10)",
    "EVI": "2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1 + 1e-10)",
    "SAVI": "1.5 * (nir - red) / (nir + red + 0.5 + 1e-10)",
    "NDWI": "(green - nir) / (green + nir + 1e-10)",
    "NDBI": "(swir - nir) / (swir + nir + 1e-10)",
}


def raster_calc(bands: DataFrame, expr: str, clip: tuple[float, float] | None = None) -> DataFrame:
    """A wide cell table's bands in an SQL expression; what isn't finite is no data."""
    v = F.expr(expr).cast("double")
    v = F.when((v == float("inf")) | (v == float("-inf")) | F.isnan(v), None).otherwise(v)
    out = bands.select("row", "col", v.alias("v"))
    return out if clip is None else out.withColumn("v", F.when(F.col("v").isNotNull(), F.least(F.greatest("v", F.lit(clip[0])), F.lit(clip[1]))))


def index(bands: DataFrame, name: str) -> DataFrame:
    return raster_calc(bands, PRESETS[name], (-1.5, 1.5) if name == "SAVI" else (-1.0, 1.0))


def align(raster: DataFrame, scale: float) -> DataFrame:
    """Resampled to cells ``scale`` times as large, by the four nearest cells; the extent decides the size."""
    n = raster.agg(F.max("row").alias("r"), F.max("col").alias("c"))
    rows = n.select(F.explode(F.sequence(F.lit(0), F.floor(F.col("r") / scale))).alias("row"), F.col("c"), F.col("r"))
    cells = rows.select("row", F.explode(F.sequence(F.lit(0), F.floor(F.col("c") / scale))).alias("col"))
    y, x = F.col("row") * F.lit(float(scale)), F.col("col") * F.lit(float(scale))
    four = [F.struct((F.floor(y) + a).alias("r"), (F.floor(x) + b).alias("c"), ((1 - F.abs(y - F.floor(y) - a)) * (1 - F.abs(x - F.floor(x) - b))).alias("w")) for a in (0, 1) for b in (0, 1)]
    src = cells.select("row", "col", F.explode(F.array(*four)).alias("s")).where("s.w > 0")
    j = src.join(raster.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "v"), (F.col("s.r") == F.col("_r")) & (F.col("s.c") == F.col("_c"))).where("v is not null")
    return j.groupBy("row", "col").agg((F.sum(F.col("v") * F.col("s.w")) / F.sum("s.w")).alias("v"))


def raster_clip(raster: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return raster.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def clip_by_polygons(raster: DataFrame, masks: DataFrame, all_touched: bool = False, size: float = 16.0) -> DataFrame:
    """Cells whose centre is in one of the polygons ``rings``; with ``all_touched`` cells that share an area with one.

    Cell ``(row, col)`` is the box from ``(col, row)`` to ``(col + 1, row + 1)``. Polygons
    and cells meet in squares of side ``size``; holes count, equal masks count once, and a
    null mask takes nothing.
    """
    masks = masks.where("rings is not null").select("rings").distinct()
    if all_touched:
        boxes = raster.select("row", "col", F.col("col").cast("double").alias("xmin2"), F.col("row").cast("double").alias("ymin2"), (F.col("col") + 1.0).alias("xmax2"), (F.col("row") + 1.0).alias("ymax2"))
        cell = F.get(g.box(F.col("xmin2"), F.col("ymin2"), F.col("xmax2"), F.col("ymax2")), F.lit(0))
        hit = box_pairs(with_bounds(masks), boxes, size).where(g.clip_area(F.col("rings"), cell) > 1e-12)
    else:
        hit = points_in(masks, raster.select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y")), size)
    return raster.join(hit.select("row", "col"), ["row", "col"], "left_semi")


def mosaic(rasters: Sequence[DataFrame]) -> DataFrame:
    """The first raster with a value wins."""
    out = None
    for k, r in enumerate(rasters):
        one = r.where("v is not null").select("row", "col", "v", F.lit(k).alias("_k"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("row", "col").agg(F.min_by("v", "_k").alias("v"))


def proximity(cells: DataFrame, features: DataFrame, most: float | None = None, degrees: bool = False, start: float = 4.0) -> DataFrame:
    """Distance from each cell to the nearest feature cell, capped at ``most``."""
    a = cells.select(F.struct("row", "col").alias("_cell"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    b = features.select(F.struct("row", "col").alias("_f"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    d = nearest_join(a, b, "_cell", "_f", start, most).groupBy("_cell").agg(F.min("d").alias("d"))
    out = a.select("_cell").join(d, "_cell", "left").select("_cell.row", "_cell.col", "d")
    out = out if most is None else out.withColumn("d", F.coalesce("d", F.lit(float(most))))
    return out.withColumn("d", F.col("d") * 111320.0) if degrees else out


def zonal_stats(raster: DataFrame, zones: DataFrame, zone: str) -> DataFrame:
    """Statistics of the cells of each zone; ``zones(row, col, zone)`` by cell centre."""
    v = F.col("v")
    counts = raster.join(zones, ["row", "col"]).where("v is not null").groupBy(zone, "v").agg(F.count("*").alias("c"))
    c = F.col("c")
    q = lambda p: F.percentile(v, F.lit(p), c)
    mean = F.sum(v * c) / F.sum(c)
    return counts.groupBy(zone).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), mean.alias("mean"), F.sum(v * c).alias("sum"), F.sum(c).alias("count"),
        F.sqrt(F.greatest(F.sum(v * v * c) / F.sum(c) - mean * mean, F.lit(0.0))).alias("std"), q(0.5).alias("median"), (F.max(v) - F.min(v)).alias("range"),
        F.min(F.struct(-c, v)).getField("v").alias("majority"), F.min(F.struct(c, v)).getField("v").alias("minority"), F.count("*").alias("unique"),
        q(0.25).alias("percentile_25"), q(0.75).alias("percentile_75"), q(0.9).alias("percentile_90"), q(0.95).alias("percentile_95"),
    )


def _gradients(dem: DataFrame, cell: float) -> DataFrame:
    """Central differences, one-sided at the edges."""

    def gradient(w) -> Column:
        a, b = F.lag("v").over(w), F.lead("v").over(w)
        return F.when(a.isNull(), (b - F.col("v")) / cell).when(b.isNull(), (F.col("v") - a) / cell).otherwise((b - a) / (2 * cell))

    return dem.withColumns({"gx": gradient(Window.partitionBy("row").orderBy("col")), "gy": gradient(Window.partitionBy("col").orderBy("row"))})


def terrain(dem: DataFrame, cell: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Slope in degrees, compass aspect, and hillshade.

    The hillshade has the altitude where the usual formula has the zenith angle; the two
    agree at 45 degrees.
    """
    gx, gy = F.coalesce("gx", F.lit(0.0)), F.coalesce("gy", F.lit(0.0))
    out = _gradients(dem, cell).withColumns({"_s": F.atan(F.hypot(gx, gy)), "_a": F.atan2(-gx, gy)})
    alt, az = math.radians(altitude), math.radians(azimuth)
    shade = F.lit(math.sin(alt)) * F.cos("_s") + F.lit(math.cos(alt)) * F.sin("_s") * F.cos(F.lit(az) - F.col("_a"))
    aspect = F.pmod(F.degrees("_a"), F.lit(360.0))
    return out.select("row", "col", F.degrees("_s").alias("slope"), aspect.alias("aspect"), F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0)).alias("hillshade"))


def _around(dem: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """``(row, col, n, v)``: the value ``v`` of the neighbour number ``n`` of each cell."""
    moves = F.array(*(F.struct(F.lit(k).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(offsets)))
    m = dem.select("row", "col", "v", F.explode(moves).alias("m"))
    return m.select((F.col("row") - F.col("m.a")).alias("row"), (F.col("col") - F.col("m.b")).alias("col"), F.col("m.n").alias("n"), "v")


def ruggedness(dem: DataFrame) -> DataFrame:
    """TRI, TPI (its mean includes the centre) and roughness on 3x3 windows, edges replicated."""
    e = dem.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    moves = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    at = lambda c, d, lo, hi: F.least(F.greatest(F.col(c) + F.col(d), F.col(lo)), F.col(hi)).cast("long")
    want = dem.join(F.broadcast(e)).select("row", "col", F.col("v").alias("z"), F.explode(moves).alias("m"), "r0", "r1", "c0", "c1").select("row", "col", "z", at("row", "m.a", "r0", "r1").alias("_r"), at("col", "m.b", "c0", "c1").alias("_c"))
    j = want.join(dem.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), "v"), ["_r", "_c"])
    s = j.groupBy("row", "col").agg(F.first("z").alias("z"), F.sum(F.pow(F.col("v") - F.col("z"), F.lit(2))).alias("_q"), F.avg("v").alias("_m"), F.max("v").alias("_hi"), F.min("v").alias("_lo"))
    return s.select("row", "col", F.sqrt("_q").alias("tri"), (F.col("z") - F.col("_m")).alias("tpi"), (F.col("_hi") - F.col("_lo")).alias("roughness"))


def contours(dem: DataFrame, interval: float) -> DataFrame:
    """Segments of each level through 2x2 windows of cells (marching squares), with their length."""
    w = _around(dem, [(0, 0), (0, 1), (1, 0), (1, 1)]).groupBy("row", "col").pivot("n", [0, 1, 2, 3]).agg(F.first("v")).na.drop()
    z = [F.col(str(k)) for k in range(4)]
    lo, hi = F.least(*z), F.greatest(*z)
    levels = F.sequence(F.ceil(lo / interval).cast("long"), F.floor(hi / interval).cast("long"))
    w = w.where(F.ceil(lo / interval) <= F.floor(hi / interval)).withColumn("level", F.explode(levels)).withColumn("level", F.col("level") * F.lit(float(interval)))
    t = lambda a, b: (F.col("level") - a) / (b - a)
    side = lambda a, b, x, y: F.when((a > F.col("level")) != (b > F.col("level")), F.struct(x.alias("x"), y.alias("y")))
    c, r = F.col("col").cast("double"), F.col("row").cast("double")
    cuts = F.array_compact(F.array(side(z[0], z[1], c + t(z[0], z[1]), r), side(z[1], z[3], c + 1, r + t(z[1], z[3])), side(z[2], z[3], c + t(z[2], z[3]), r + 1), side(z[0], z[2], c, r + t(z[0], z[2]))))
    p = w.select("row", "col", "level", cuts.alias("p")).where(F.size("p") >= 2)
    pairs = F.when(F.size("p") == 4, F.array(F.struct(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(3)).alias("b")), F.struct(F.get("p", F.lit(1)).alias("a"), F.get("p", F.lit(2)).alias("b")))).otherwise(F.array(F.struct(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))))
    out = p.select("level", F.explode(pairs).alias("s")).select("level", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    return out.withColumn("length", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")))


def smooth(dem: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing, rows then columns, cut at four deviations; missing neighbours don't count."""
    n = max(1, round(4 * sigma))
    for part, order in (("row", "col"), ("col", "row")):
        moves = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(math.exp(-d * d / (2 * sigma * sigma))).alias("w")) for d in range(-n, n + 1)))
        m = dem.where("v is not null").select(part, F.col(order).alias("_o"), "v", F.explode(moves).alias("m")).withColumn("_at", F.col("_o") + F.col("m.d"))
        s = m.groupBy(part, F.col("_at").alias(order)).agg((F.sum(F.col("v") * F.col("m.w")) / F.sum("m.w")).alias("v"))
        dem = dem.select("row", "col").join(s, ["row", "col"], "left")
    return dem


def flow_direction(dem: DataFrame, cell: float = 1.0) -> DataFrame:
    """The steepest way down among eight neighbours as a direction code, 0 where none leads down."""
    n = _around(dem, [(a, b) for a, b, _ in D8])
    # files of rasters are small beside their rows, so Spark would send the cells whole to the driver without the hint
    j = dem.select("row", "col", F.col("v").alias("z")).join(n.withColumnRenamed("v", "zn").hint("merge"), ["row", "col"])
    far = F.when(F.col("n") % 2 == 0, float(cell)).otherwise(cell * math.sqrt(2))
    best = j.groupBy("row", "col").agg(F.max(F.struct(((F.col("z") - F.col("zn")) / far).alias("drop"), (-F.col("n")).alias("m"))).alias("b"))
    code = F.element_at(F.array(*(F.lit(c) for *_, c in D8)), (-F.col("b.m") + 1).cast("int"))
    return best.select("row", "col", F.when(F.col("b.drop") > 0, code).otherwise(0).alias("dir"))


def flow_edges(fdir: DataFrame) -> DataFrame:
    """``(row, col, to_row, to_col)`` of cells that flow somewhere."""
    da = sum((F.when(F.col("dir") == c, a).otherwise(0) for a, _, c in D8[1:]), F.when(F.col("dir") == D8[0][2], D8[0][0]).otherwise(0))
    db = sum((F.when(F.col("dir") == c, b).otherwise(0) for _, b, c in D8[1:]), F.when(F.col("dir") == D8[0][2], D8[0][1]).otherwise(0))
    return fdir.where("dir != 0").select("row", "col", (F.col("row") + da).alias("to_row"), (F.col("col") + db).alias("to_col"))


def flow_accumulation(fdir: DataFrame) -> DataFrame:
    """Cells that drain through each cell, itself included.

    Pointer doubling: in each round all water moves twice as far as in the one before, so
    a river of ``L`` cells takes ``log2 L`` rounds. All joins are merged: no table of cells
    goes to the driver, however well it is packed in its files.
    """
    fdir = cut(fdir)
    cells = fdir.select("row", "col")
    hop = cut(flow_edges(fdir).join(cells.select(F.col("row").alias("to_row"), F.col("col").alias("to_col")).hint("merge"), ["to_row", "to_col"]).select("row", "col", "to_row", "to_col"))
    acc = cells.withColumn("acc", F.lit(1).cast("long"))
    while True:
        came = acc.join(hop.hint("merge"), ["row", "col"]).groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("acc").alias("more"))
        acc = cut(acc.join(came.hint("merge"), ["row", "col"], "left").select("row", "col", (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
        on = hop.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("_r"), F.col("to_col").alias("_c"))
        hop = cut(hop.join(on.hint("merge"), ["to_row", "to_col"]).select("row", "col", F.col("_r").alias("to_row"), F.col("_c").alias("to_col")))
        if hop.isEmpty():
            return acc


def catchment(fdir: DataFrame, row: int, col: int) -> DataFrame:
    """All cells that drain to one cell, itself included."""
    return catchment_of(flow_edges(fdir), fdir, row, col)


def streams(acc: DataFrame, fdir: DataFrame, fraction: float) -> DataFrame:
    """Edges between cells whose accumulation is at least ``fraction`` of the largest."""
    top = F.broadcast(acc.agg(F.max("acc").alias("top")))
    cells = acc.join(top).where(F.col("acc") >= F.col("top") * fraction).select("row", "col", "acc")
    e = flow_edges(fdir).join(cells.hint("merge"), ["row", "col"])
    return e.join(cells.select(F.col("row").alias("to_row"), F.col("col").alias("to_col")).hint("merge"), ["to_row", "to_col"], "left_semi").select("row", "col", "to_row", "to_col", "acc")


def stream_stats(edges: DataFrame, orders: DataFrame, area: float) -> DataFrame:
    """Length by order, and drainage density: all length over ``area``."""
    e = edges.join(orders.hint("merge"), edges.src == orders.node)
    total = F.sum("length").over(Window.partitionBy())
    return e.groupBy("ord").agg(F.sum("length").alias("length"), F.count("*").alias("n")).withColumn("density", total / area)


def change_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("row", "col", F.col("v").alias("from_class")).join(b.select("row", "col", F.col("v").alias("to_class")), ["row", "col"]).groupBy("from_class", "to_class").agg(F.count("*").alias("n"))
