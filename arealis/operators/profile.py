"""Summaries of tables and columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.functions.columns import smart_round
from arealis.operators.rank import row_rank


def unpivot(df: DataFrame, fields: Sequence[str], kind: str = "double", keep: Sequence[str] = ()) -> DataFrame:
    """``(…keep, field, value)``, one row for each field and row."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast(kind).alias("value")) for f in fields))
    return df.select(*keep, F.explode(pairs).alias("e")).select(*keep, "e.*")


def _stats(v: Column) -> list[Column]:
    q = lambda p: F.percentile(v, F.lit(p))
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max(v).alias("max"), F.count_if(v.isNull()).alias("nulls")]


def summary_stats(df: DataFrame, fields: Sequence[str], where: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, linear quartiles and nulls of each field, in one pass."""
    df = df.filter(where) if where else df
    return unpivot(df, fields, keep=by).groupBy(*by, "field").agg(*_stats(F.col("value")))


def rounded(stats: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``summary_stats`` with each field's rounding."""
    cols = {}
    for c in ("mean", "std", "min", "p25", "median", "p75", "max"):
        out = F.col(c)
        for f in fields:
            out = F.when(F.col("field") == f, smart_round(F.col(c), f)).otherwise(out)
        cols[c] = out
    return stats.withColumns(cols)


def compare(projects: Mapping[str, DataFrame], cols: Sequence[str]) -> DataFrame:
    """The same statistics, with p90 and p95, side by side for several projects."""
    out = None
    for name, d in projects.items():
        one = unpivot(d, cols).withColumn("project", F.lit(name))
        out = one if out is None else out.unionByName(one)
    v = F.col("value")
    return out.groupBy("project", "field").agg(*_stats(v), F.percentile(v, F.lit(0.9)).alias("p90"), F.percentile(v, F.lit(0.95)).alias("p95"))


def data_dictionary(df: DataFrame, value_list: int = 10) -> DataFrame:
    """For each column: type, share of nulls, distinct values, ends, and all values if they are few."""
    types = F.create_map(*(F.lit(x) for c, t in df.dtypes for x in (c, t)))
    long = unpivot(df, df.columns, "string")
    counts = long.groupBy("field", "value").agg(F.count("*").alias("c"))
    few = F.row_number().over(Window.partitionBy("field").orderBy("value"))
    heads = counts.where("value is not null").withColumn("r", few).where(F.col("r") <= value_list + 1).groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("v"))
    stats = counts.groupBy("field").agg(F.sum("c").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("nulls"), F.count("value").alias("distinct_values"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))
    out = stats.join(heads, "field", "left")
    return out.select("field", types[F.col("field")].alias("type"), F.round(100.0 * F.col("nulls") / F.col("rows"), 2).alias("null_pct"), "distinct_values", "first_value", "last_value", F.when(F.col("distinct_values") <= value_list, F.array_join("v", "|")).alias("value_list"))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    """The ``k`` most frequent values of each column, ties by value."""
    counts = unpivot(df, cols, "string").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    out = df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)
    return out.limit(k) if k else out


def null_coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls and their share for each column."""
    return unpivot(df, cols, "string").groupBy("field").agg(F.count_if(F.col("value").isNull()).alias("nulls"), F.round(100.0 * F.count_if(F.col("value").isNull()) / F.count("*"), 2).alias("null_pct"))


def correlation(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs of fields, in one pass."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("e")).select("e.*")


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins; the last one is closed."""
    v = F.col(col).cast("double")
    ends = F.broadcast(df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((v - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return df.where(v.isNotNull()).join(ends).select(at.cast("int").alias("bin"), (F.col("lo") + at * width).alias("bin_start")).groupBy("bin").agg(F.min("bin_start").alias("bin_start"), F.count("*").alias("n"))


def hexbin(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Counts in hexagons of axial coordinates ``(q, r)``; empty ones have no row."""
    q = (F.col(x) * (3**0.5 / 3) - F.col(y) / 3) / size
    r = F.col(y) * (2 / 3) / size
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    hq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    hr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(hq.cast("long").alias("q"), hr.cast("long").alias("r")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 times their distance, and how many values lie outside."""
    v = F.col(col)
    q = df.groupBy(by).agg(*(F.percentile(v, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))
    q = q.withColumns({"_lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "_hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    inside = v.between(F.col("_lo"), F.col("_hi"))
    return df.join(q, by).groupBy(by, "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("outliers"))


def category_bars(df: DataFrame, category: str, values: Sequence[str], top_n: int) -> DataFrame:
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return df.where(F.col(category).isNotNull() & total.isNotNull()).withColumn("total", total).orderBy(F.desc("total"), category).limit(top_n).select(category, *values, "total")


def temporal_profile(df: DataFrame, ts: str, grain: str, by: Sequence[str] = ()) -> DataFrame:
    """Events by hour, weekday (0 Monday), month or season, and their mean per observed day."""
    # Seasons of the northern year by month.
    season = F.element_at(F.array(*map(F.lit, ("winter", "spring", "summer", "autumn"))), (F.floor(F.col("_m") % 12 / 3) + 1).cast("int"))
    parts = {"hour": F.hour(ts), "weekday": F.weekday(ts), "month": F.month(ts), "season": season}
    rows = df.where(F.col(ts).isNotNull()).withColumn("_m", F.month(ts)).withColumns({"bucket": parts[grain].cast("string"), "_d": F.to_date(ts)})
    out = rows.groupBy(*by, "bucket").agg(F.count("*").alias("events"), F.count_distinct("_d").alias("days"))
    return out.withColumn("per_day", F.col("events") / F.col("days"))


def hour_weekday(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).pivot("weekday", list(range(7))).count() if "weekday" in df.columns else hour_weekday(df.withColumn("weekday", F.weekday(ts)), ts)


def rollup(df: DataFrame, crosswalk: DataFrame, key: str, to: str, counts: Sequence[str], rates: Mapping[str, tuple[str, str]] = {}, medians: Sequence[str] = ()) -> DataFrame:  # noqa: B006
    """Values of small areas summed into larger ones: counts by weight, rates from their parts.

    ``crosswalk(key, to, weight)``. A median has no roll-up and is refused.
    """
    if medians:
        raise ValueError(f"medians can't be rolled up: {', '.join(medians)}")
    w = F.col("weight")
    j = df.join(crosswalk, key)
    s = lambda c: F.sum(F.col(c) * w)
    return j.groupBy(to).agg(*(s(c).alias(c) for c in counts), *((100 * s(a) / F.nullif(s(b), F.lit(0.0))).alias(r) for r, (a, b) in rates.items()))


def _tile(df: DataFrame, col: str, tie: str, k: int, name: str) -> DataFrame:
    """1..k of equal size by rank; the first ones take what is left over."""
    rows = row_rank(df, col, [tie], name="_r")
    n = F.broadcast(rows.agg(F.count("_r").alias("_n")))
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    i, cut = F.col("_r") - 1, more * (size + 1)
    tile = F.when(i < cut, F.floor(i / (size + 1))).otherwise(more + F.floor((i - cut) / F.greatest(size, F.lit(1)))) + 1
    return rows.join(n).withColumn(name, tile.cast("int")).drop("_r", "_n")


def crosstab(df: DataFrame, a: str, b: str, tie: str, k: int = 5) -> DataFrame:
    """Rows by quantile class of two measures; ``tie`` orders equal values."""
    wide = _tile(_tile(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, tie, k, "a_class"), b, tie, k, "b_class")
    return wide.groupBy("a_class", "b_class").agg(F.count("*").alias("n"))


def facet_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return unpivot(df, cols, "string").groupBy("field", "value").agg(F.count("*").alias("n"))


def od_flows(df: DataFrame, crosswalk: DataFrame, origin: str, destination: str, value: str) -> DataFrame:
    """Flows between places summed between the areas that ``crosswalk(id, area)`` names."""
    o = crosswalk.select(F.col("id").alias(origin), F.col("area").alias("origin_area"))
    d = crosswalk.select(F.col("id").alias(destination), F.col("area").alias("destination_area"))
    return df.join(o, origin).join(d, destination).groupBy("origin_area", "destination_area").agg(F.sum(value).alias("flow"), F.count("*").alias("pairs"))
