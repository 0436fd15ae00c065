"""Class breaks and what they assign."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.operators.shapes import convex_pieces
from arealis.sources.shared import cut


def _distinct(breaks: Sequence[float]) -> list[float]:
    out = list(dict.fromkeys(float(b) for b in breaks))
    return out if len(out) > 1 else [*out, *(b + 1 for b in out)]


def ranked_values(df: DataFrame, col: str, ranks: Sequence[int]) -> list[float]:
    """Values at 0-based places of the sorted column.

    Equal values are counted first and only the sums of a few hundred ranges are looked
    at in order, so neither the driver nor one task sorts the rows.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n"))
    parts = counts.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("p").agg(F.sum("n").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    to = F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    placed = parts.join(offsets.select("p", "before"), "p").withColumn("hi", to).withColumn("lo", F.col("hi") - F.col("n"))
    wanted = F.array(*(F.lit(int(r)).cast("long") for r in dict.fromkeys(ranks)))
    hit = placed.withColumn("r", F.explode(F.filter(wanted, lambda r: (r >= F.col("lo")) & (r < F.col("hi")))))
    found = {row.r: row.v for row in hit.select("r", "v").collect()}
    return [found[int(r)] for r in ranks]


def breaks(df: DataFrame, col: str, k: int, scheme: str = "quantile") -> list[float]:
    """Edges of ``k`` classes, at most; fewer if values coincide.

    ``equal_interval``, ``quantile`` and its synonym ``natural_breaks`` (values picked at
    ranks ``n * i // k``), ``std_mean`` (mean and one and two deviations).
    """
    s = df.agg(F.count(col).alias("n"), F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std")).first()
    if not s.n:
        return []
    if scheme == "equal_interval":
        step = (s.hi - s.lo) / k or 1.0
        return _distinct([s.lo + step * i for i in range(k)] + [s.hi if s.hi > s.lo else s.lo + k * step])
    if scheme == "std_mean":
        std = s.std or 0.0
        return _distinct([s.lo, *sorted(b for b in (s.mean + d * std for d in (-2, -1, 1, 2)) if s.lo < b < s.hi), s.hi])
    return _distinct(ranked_values(df, col, [min(s.n * i // k, s.n - 1) for i in range(k + 1)]))


def shared_breaks(dfs: Sequence[DataFrame], cols: Sequence[str], k: int, scheme: str = "quantile") -> list[float]:
    """Breaks of several columns and tables pooled."""
    return breaks(pool(dfs, cols), "value", k, scheme)


def pool(dfs: Sequence[DataFrame], cols: Sequence[str]) -> DataFrame:
    out = None
    for d in dfs:
        for c in (c for c in cols if c in d.columns):
            one = d.select(F.col(c).cast("double").alias("value"))
            out = one if out is None else out.unionByName(one)
    return out


def class_of(value: Column, edges: Sequence[float]) -> Column:
    """0-based class: the first whose upper edge isn't below the value; values beyond get the last."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:-1]):
        out = out.when(value <= upper, i)
    return out.otherwise(len(edges) - 2)


def classify(df: DataFrame, col: str, k: int, scheme: str = "quantile") -> DataFrame:
    return df.withColumn("class", class_of(F.col(col), breaks(df, col, k, scheme)))


def bivariate(df: DataFrame, x: str, y: str, n: int = 3) -> DataFrame:
    """Code ``class(y) * n + class(x)`` by linear quantiles."""
    probs = F.array(*(F.lit(i / n) for i in range(1, n)))
    e = F.broadcast(df.agg(F.percentile(x, probs).alias("_ex"), F.percentile(y, probs).alias("_ey")))
    code = lambda c, a: F.size(F.filter(a, lambda b: F.col(c) > b))
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(e)
    return out.withColumn("bivariate", code(y, "_ey") * n + code(x, "_ex")).drop("_ex", "_ey")


def classification_spread(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Distinct values and deviation of each column, and whether ``k`` classes make no sense."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in cols))).alias("e")).select("e.*")
    out = long.groupBy("field").agg(F.count_distinct("v").alias("distinct_values"), F.stddev_samp("v").alias("std"))
    return out.withColumn("degenerate", (F.col("distinct_values") < k) | (F.coalesce("std", F.lit(0.0)) < 0.001))


def sqrt_scale(df: DataFrame, col: str, low: float = 20.0, high: float = 800.0) -> DataFrame:
    """Symbol size between ``low`` and ``high`` by the square root of the value."""
    top = F.broadcast(df.agg(F.sqrt(F.greatest(F.max(col), F.lit(0.0))).alias("_top")))
    size = low + (high - low) * F.sqrt(F.greatest(F.col(col), F.lit(0.0))) / F.nullif(F.col("_top"), F.lit(0.0))
    return df.join(top).withColumn("size", F.coalesce(size, F.lit(low))).drop("_top")


def dot_unit(df: DataFrame, cols: Sequence[str], most: int = 50_000) -> float:
    """What a dot stands for so that about ``most`` dots are drawn for all columns: the total by ``most``, 1 at least."""
    total = df.agg(*(F.sum(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(f"s{i}") for i, c in enumerate(cols))).first()
    return max(1.0, sum(v or 0.0 for v in total) / most)


def dots(df: DataFrame, col: str, unit: float, key: str, seed: int = 0) -> DataFrame:
    """``round(value / unit)`` points for each row, at places drawn from its box by a seeded hash.

    Needs ``xmin, ymin, xmax, ymax``; ``dots_inside`` keeps to the polygon.
    """
    n = F.coalesce(F.bround(F.greatest(F.col(col), F.lit(0.0)) / unit, 0).cast("int"), F.lit(0))
    rows = df.where(n > 0).withColumn("dot", F.explode(F.sequence(F.lit(1), n)))
    u = lambda s: F.pmod(F.xxhash64(F.lit(seed), F.lit(s), F.col(key), F.col("dot")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.withColumns({"x": F.col("xmin") + (F.col("xmax") - F.col("xmin")) * u(1), "y": F.col("ymin") + (F.col("ymax") - F.col("ymin")) * u(2)})


def dots_inside(df: DataFrame, col: str, unit: float, key: str, seed: int = 0) -> DataFrame:
    """``(key, dot, x, y)``: ``round(value / unit)`` points inside each row's polygon ``rings``, of any shape.

    A polygon becomes triangles; a seeded hash picks one by its share of the area and a
    place in it, so no point is drawn in vain and none is lost. Keys are unique; rows
    without a polygon that has an area get no dots.
    """
    n = F.coalesce(F.bround(F.greatest(F.col(col), F.lit(0.0)) / unit, 0).cast("int"), F.lit(0))
    parts = convex_pieces(df.where(n > 0).select(key, "rings")).drop("rings")
    third = lambda i: F.struct(F.get("piece", F.lit(0)).alias("a"), F.get("piece", i).alias("b"), F.get("piece", i + 1).alias("c"))
    fan = parts.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("piece") - 2), third)).alias("t")).select(key, "t.*")
    size = F.abs((F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("a.y")) - (F.col("b.y") - F.col("a.y")) * (F.col("c.x") - F.col("a.x")))
    w = Window.partitionBy(key).orderBy("a", "b", "c")
    fan = fan.withColumn("s", size).withColumns({"hi": F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("s").over(Window.partitionBy(key))})
    fan = fan.withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0))).withColumn("last", F.lead("hi").over(w).isNull())
    u = lambda s: F.pmod(F.xxhash64(F.lit(seed), F.lit(s), F.col(key), F.col("dot")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = df.where(n > 0).select(key, F.explode(F.sequence(F.lit(1), n)).alias("dot")).withColumns({"u": u(1), "p": F.sqrt(u(2)), "q": u(3)})
    hit = drawn.join(fan, key).where((F.col("u") * F.col("all") >= F.col("lo")) & ((F.col("u") * F.col("all") < F.col("hi")) | F.col("last")))
    at = lambda k: (1 - F.col("p")) * F.col(f"a.{k}") + F.col("p") * ((1 - F.col("q")) * F.col(f"b.{k}") + F.col("q") * F.col(f"c.{k}"))
    return hit.select(key, "dot", at("x").alias("x"), at("y").alias("y"))


def fisher_classes(n: np.ndarray, total: np.ndarray, squares: np.ndarray, k: int) -> list[int]:
    """The last place of each of ``k`` classes of sorted groups with the least sum of squares within (Fisher 1958).

    Groups have ``n`` values, their sum and their sum of squares. The best cut before a
    place never moves left as places go right, so each further class is found by halving
    (divide and conquer) in ``m log m`` steps.
    """
    m = len(n)
    k = min(k, m)
    cn, cs, cq = (np.r_[0.0, np.cumsum(x)] for x in (n, total, squares))
    cost = lambda i, j: np.maximum(cq[j] - cq[i] - (cs[j] - cs[i]) ** 2 / (cn[j] - cn[i]), 0.0)  # noqa: E731  of groups i to j - 1
    best, cuts = cost(np.zeros(m, int), np.arange(1, m + 1)), []
    for c in range(1, k):
        now, cut_at = np.full(m, np.inf), np.zeros(m, dtype=int)
        todo = [(c, m - 1, c, m - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(left, min(mid, right) + 1)  # the last class starts here
            v = best[i - 1] + cost(i, mid + 1)
            at = int(v.argmin())
            now[mid], cut_at[mid] = v[at], i[at]
            todo += [(lo, mid - 1, left, int(i[at])), (mid + 1, hi, int(i[at]), right)]
        best = now
        cuts.append(cut_at)
    ends = [m - 1]
    for cut_at in cuts[::-1]:
        ends.append(int(cut_at[ends[-1]]) - 1)
    return ends[::-1]


def natural_breaks(df: DataFrame, col: str, k: int, most: int = 20_000) -> list[float]:
    """Edges of ``k`` classes with the least variance within (Jenks), by Fisher's exact programme.

    Equal values are counted first. Up to ``most`` different values go to the driver
    with their counts, and the classes are the best there are. More are gathered in runs
    of neighbours, ``most`` at most, by their number, sum and squares; runs at which a
    class ends are then split into runs of their own until classes end between single
    values, so only runs away from all ends stay whole. Fewer edges if there are fewer
    values; nulls and NaN are left out, no values give no edges.
    """
    v = F.col(col).cast("double")
    counts = cut(df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count("*").alias("n")))
    s = counts.agg(F.count("*").alias("different"), F.min("v").alias("lo"), F.sum(F.col("v") * F.col("n")).alias("sum"), F.sum("n").alias("n")).first()
    if not s.different:
        return []
    x = F.col("v") - s["sum"] / s.n  # about the mean, so that squares keep their digits
    sums = [F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n"), F.sum(x * F.col("n")).alias("s"), F.sum(x * x * F.col("n")).alias("q"), F.count("*").alias("d")]
    if s.different <= most:
        runs = counts.groupBy("v").agg(*sums).orderBy("lo").collect()
    else:
        ranges = max(1, most // 256)
        parts = counts.repartitionByRange(ranges, "v").withColumn("p", F.spark_partition_id())
        parts = parts.withColumn("t", F.ntile(max(1, most // ranges)).over(Window.partitionBy("p").orderBy("v")))
        runs = sorted(parts.groupBy("p", "t").agg(*sums).drop("p", "t").collect(), key=lambda r: r.lo)
    while True:
        ends = fisher_classes(*(np.array([r[c] for r in runs], dtype=float) for c in ("n", "s", "q")), k)
        coarse = [runs[i] for i in sorted({j for e in ends[:-1] for j in (e, e + 1)}) if runs[i].d > 1]
        if not coarse:
            return _distinct([s.lo, *(runs[e].hi for e in ends)])
        which = F.lit(None).cast("int")
        for i, r in enumerate(coarse):
            which = F.when(F.col("v").between(r.lo, r.hi), i).otherwise(which)
        inside = counts.withColumn("p", which).where("p is not null")
        tiles = F.ntile(max(2, most // (2 * len(coarse)))).over(Window.partitionBy("p").orderBy("v"))
        fine = inside.withColumn("t", tiles).groupBy("p", "t").agg(*sums).drop("p", "t").collect()
        gone = set(map(id, coarse))
        runs = sorted([r for r in runs if id(r) not in gone] + fine, key=lambda r: r.lo)
