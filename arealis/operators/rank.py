"""Ranks, scores and their scaling, without sorting a table in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.operators.spatial import near_pairs
from arealis.sources.shared import cut


def value_buckets(df: DataFrame, col: str, parts: int = 64) -> Column:
    """The bucket of each value among about ``parts`` of equal size; equal values share one.

    The bounds are approximate quantiles (one number each on the driver); nulls get -1.
    """
    probs = [i / parts for i in range(1, parts)]
    bounds = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, 2000).alias("b")).first().b or []
    bounds = sorted(set(bounds))
    v = F.col(col).cast("double")
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < v)) if bounds else F.lit(0)
    return F.when(v.isNull(), -1).otherwise(below)


def with_offsets(df: DataFrame, col: str) -> DataFrame:
    """``df`` with its bucket ``_p`` and the number of non-null rows in the buckets ``_before`` it and in all, ``_all``."""
    rows = df.withColumn("_p", value_buckets(df, col))
    counts = rows.where("_p >= 0").groupBy("_p").agg(F.count("*").alias("_n"))
    run = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    return rows.join(F.broadcast(offsets), "_p", "left")


def row_rank(df: DataFrame, col: str, tie: Sequence[str], descending: bool = False, name: str = "rank") -> DataFrame:
    """1..N by ``col``, then by the ``tie`` columns; rows without a value get no rank."""
    rows = with_offsets(df, col)
    order = [F.desc(col) if descending else F.asc(col), *tie]
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    inside = F.count("*").over(Window.partitionBy("_p"))
    place = F.col("_all") - F.col("_before") - inside + within if descending else F.col("_before") + within
    return rows.withColumn(name, F.when(F.col(col).isNotNull(), place)).drop("_p", "_before", "_all")


def top_bottom(df: DataFrame, field: str, n: int, tie: str, extra: Sequence[str] = ()) -> DataFrame:
    """The ``n`` highest and lowest rows, ranked 1..n each; rows without a value are left out."""
    rows = df.where(F.col(field).isNotNull()).select(tie, field, *extra)

    def part(name: str, order: Column) -> DataFrame:
        cut = rows.orderBy(order, tie).limit(n)
        return cut.select(F.lit(name).alias("side"), F.row_number().over(Window.orderBy(order, tie)).alias("rank"), tie, field, *extra)

    return part("top", F.desc(field)).unionByName(part("bottom", F.asc(field)))


def top_n(df: DataFrame, field: str, n: int, tie: str, ascending: bool = False) -> DataFrame:
    return df.where(F.col(field).isNotNull()).orderBy(F.asc(field) if ascending else F.desc(field), tie).limit(n)


def minmax(df: DataFrame, specs: Mapping[str, str]) -> DataFrame:
    """``<column>_norm`` between 0 and 1, turned round where the spec says ``lower``.

    A constant column gives 0.5 either way, a null stays null.
    """
    ends = F.broadcast(df.agg(*(f(c).cast("double").alias(f"_{n}_{c}") for c in specs for n, f in (("lo", F.min), ("hi", F.max)))))
    out = df.join(ends)
    for c, direction in specs.items():
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        up = (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))
        norm = 1 - up if direction == "lower" else up
        out = out.withColumn(f"{c}_norm", F.when(F.col(c).isNull(), None).otherwise(F.coalesce(norm, F.lit(0.5))))
    return out.drop(*(f"_{n}_{c}" for c in specs for n in ("lo", "hi")))


def score_sites(df: DataFrame, weights: Mapping[str, tuple[float, str]], tie: str, top: int | None = None) -> DataFrame:
    """Weighted score of 0 to 100 and its rank.

    ``weights[column] = (weight, 'higher' or 'lower')``; weights that don't sum to 1 are
    rescaled. A missing competitor density is 0, a missing distance to the nearest 5.
    """
    # What stands in for factors that a table lacks.
    stand_in = {"competitor_density": 0.0, "gap_to_nearest": 5.0}
    df = df.withColumns({c: F.lit(stand_in[c]) for c in weights if c not in df.columns and c in stand_in})
    total = sum(w for w, _ in weights.values())
    scale = 1 / total if abs(total - 1) > 0.01 else 1.0
    out = minmax(df, {c: d for c, (_, d) in weights.items()})
    score = sum((F.coalesce(f"{c}_norm", F.lit(0.0)) * (w * scale) for c, (w, _) in weights.items()), F.lit(0.0))
    out = row_rank(out.withColumn("score", F.bround(score * 100, 1)), "score", [tie], descending=True)
    return out.where(F.col("rank") <= top) if top else out


def demand_score(df: DataFrame, density: str, income: str, tie: str, population: str | None = None, min_pop: float = 0) -> DataFrame:
    """Density and income relative to their maxima, multiplied, in percent."""
    rows = df.where(F.col(population) >= min_pop) if population else df
    tops = F.broadcast(rows.agg(F.max(density).alias("_d"), F.max(income).alias("_i")))
    score = F.bround(F.col(density) / F.nullif(F.col("_d"), F.lit(0.0)) * (F.col(income) / F.nullif(F.col("_i"), F.lit(0.0))) * 100, 1)
    return row_rank(rows.join(tops).withColumn("demand", F.coalesce(score, F.lit(0.0))).drop("_d", "_i"), "demand", [tie], descending=True)


def pct_rank(df: DataFrame, col: str, tiles: int = 5) -> DataFrame:
    """Percentile rank (ties share the lowest) and quantile class of each value."""
    rows = with_offsets(df, col)
    w = Window.partitionBy("_p").orderBy(col)
    lowest = F.col("_before") + F.rank().over(w) - 1
    p = F.when(F.col("_all") > 1, lowest / (F.col("_all") - 1)).otherwise(0.0)
    out = rows.withColumn("pct_rank", F.when(F.col(col).isNotNull(), p))
    return out.withColumn("tile", F.least((F.col("pct_rank") * tiles).cast("int") + 1, F.lit(tiles))).drop("_p", "_before", "_all")


def context(lines: DataFrame, doc: str, line_no: str, text: str, hit: Column, n: int = 3) -> DataFrame:
    """Lines that match, with up to ``n`` lines on either side."""
    w = Window.partitionBy(doc).orderBy(line_no).rowsBetween(-n, n)
    return lines.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n")).where(hit)


def stage_status(log: DataFrame, run: str, stage: str, event: str, ts: str) -> DataFrame:
    """For each run and stage its last start and end, status and seconds."""
    t = lambda e: F.max(F.when(F.col(event) == e, F.col(ts)))
    out = log.groupBy(run, stage).agg(t("stage_start").alias("started"), t("stage_end").alias("ended"), F.count_if(F.col(event) == "stage_start").alias("starts"))
    done = F.col("ended") >= F.col("started")
    status = F.when(F.col("started").isNull(), "pending").when(F.coalesce(done, F.lit(False)), "completed").when(F.col("starts") > 1, "restarted").otherwise("running")
    seconds = F.when(done, F.unix_timestamp("ended") - F.unix_timestamp("started"))
    return out.withColumns({"status": status, "seconds": seconds})


def thin(df: DataFrame, order: str, x: str, y: str, distance: float, max_rounds: int = 200) -> DataFrame:
    """Rows that a walk in ``order`` keeps if a point within ``distance`` was not kept before.

    Rounds over the pairs of near points: a row goes when a lower near one stays, and
    stays when all lower near ones have gone. This ends with what the walk gives.
    Of rows in one place only the first can stay, so the pairs are of different places.
    """
    every = df.select(F.col(order).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    pts = every.where(placed).groupBy("x", "y").agg(F.min("id").alias("id")).unionByName(every.where(~placed))
    pts = cut(pts.select("id", "x", "y"))
    pairs = cut(near_pairs(pts, pts.withColumnsRenamed({"id": "id2", "x": "x2", "y": "y2"}), distance, strict=True).where("id2 < id").select("id", "id2"))
    open_rows, kept = pts.select("id"), pts.select("id").limit(0)
    for _ in range(max_rounds):
        waits = pairs.join(open_rows, "id", "left_semi").join(open_rows.select(F.col("id").alias("id2")), "id2", "left_semi")
        now = open_rows.join(waits.select("id").distinct(), "id", "left_anti")
        gone = pairs.join(now.select(F.col("id").alias("id2")), "id2", "left_semi").select("id").distinct()
        kept = cut(kept.unionByName(now))
        open_rows = cut(open_rows.join(now, "id", "left_anti").join(gone, "id", "left_anti"))
        if open_rows.isEmpty():
            return df.join(kept.withColumnRenamed("id", order), order, "left_semi")
    raise RuntimeError("thinning did not end")


def renumber(df: DataFrame, order: str, name: str = "zone_id", tie: Sequence[str] = ()) -> DataFrame:
    """Ids 1..N without gaps in the order of a column, as after a filter; rows without a value get none."""
    return row_rank(df, order, tie, name=name)
