"""Rates with margins of error, reliability, and change between vintages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_rate(df: DataFrame, num: str, den: str, out: str, moe_num: str | None = None, moe_den: str | None = None) -> DataFrame:
    """Percentage ``num / den``; with margins also its margin and whether it is reliable.

    A zero denominator gives null. A null margin counts as reliable, a null rate does not.
    """
    d = F.nullif(F.col(den).cast("double"), F.lit(0.0))
    df = df.withColumn(out, F.col(num) / d * 100)
    if moe_num and moe_den:
        moe = F.sqrt(F.pow(F.col(moe_num), F.lit(2)) + F.pow(F.col(num) / d * F.col(moe_den), F.lit(2))) / d * 100
        df = df.withColumn(f"{out}_moe", moe)
        fine = F.coalesce(~(F.col(f"{out}_moe") > F.abs(out) * 0.5), F.lit(True)) & F.col(out).isNotNull()
        df = df.withColumn(f"{out}_reliable", fine)
    return df


def reliability(df: DataFrame, est: str, moe: str) -> DataFrame:
    """Coefficient of variation and class of each estimate."""
    e, m = F.col(est), F.col(moe)
    cv = m / F.lit(1.645) / F.nullif(F.abs(e), F.lit(0.0)) * 100
    # Class names and the bounds 15 and 30.
    label = (
        F.when(e.isNull() | (F.abs(e) < 1e-9), "Effectively Zero")
        .when(m > F.abs(e), "Essentially Meaningless")
        .when(F.col("cv") < 15, "Reliable")
        .when(F.col("cv") < 30, "Use with Caution")
        .otherwise("Unreliable")
    )
    return df.withColumn("cv", cv).withColumn("reliability", label)


def reliability_summary(df: DataFrame) -> DataFrame:
    """Count and share of each class, and the spread of its coefficients."""
    counts = df.groupBy("reliability").agg(F.count("*").alias("n"), F.avg("cv").alias("mean_cv"), F.max("cv").alias("max_cv"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("reliability", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"), "mean_cv", "max_cv")


def change_detection(base: DataFrame, current: DataFrame, cols: list[str], key: str) -> DataFrame:
    """Baseline, current, absolute and percentage change of each column, for all baseline keys."""
    b = base.select(F.col(key).cast("string").alias(key), *(F.col(c).alias(f"{c}_base") for c in cols))
    k = next(c for c in current.columns if c.lower() == key.lower())
    n = current.select(F.col(k).cast("string").alias(key), *(F.col(c).alias(f"{c}_current") for c in cols))
    out = b.join(n, key, "left")
    for c in cols:
        out = out.withColumn(f"{c}_change", F.col(f"{c}_current") - F.col(f"{c}_base"))
        out = out.withColumn(f"{c}_change_pct", F.col(f"{c}_change") / F.nullif(F.abs(f"{c}_base"), F.lit(0.0)) * 100)
    return out


def change_summary(df: DataFrame, col: str, higher_is_better: bool = True) -> DataFrame:
    """One row over all areas: spread of the change, and how many got better or worse."""
    c = F.col(f"{col}_change")
    up, down = F.count_if(c > 0), F.count_if(c < 0)
    better, worse = (up, down) if higher_is_better else (down, up)
    return df.agg(
        F.avg(c).alias("mean_change"),
        F.percentile(c, F.lit(0.5)).alias("median_change"),
        F.min(c).alias("min_change"),
        F.max(c).alias("max_change"),
        better.alias("improved"),
        worse.alias("worsened"),
        F.count_if(c == 0).alias("unchanged"),
        F.count_if(c.isNull()).alias("no_data"),
    )


def cagr(first: Column, last: Column, years: float) -> Column:
    """Compound yearly growth; null unless both ends are positive."""
    return F.when((first > 0) & (last > 0), F.pow(last / first, F.lit(1.0 / years)) - 1)


def share_shift(df: DataFrame, part0: str, whole0: str, part1: str, whole1: str) -> DataFrame:
    """Share at both ends in percent, the shift in points, and the change in count."""
    s0 = 100.0 * F.col(part0) / F.nullif(F.col(whole0), F.lit(0))
    s1 = 100.0 * F.col(part1) / F.nullif(F.col(whole1), F.lit(0))
    return df.withColumns({"share_base": s0, "share_current": s1, "share_points": s1 - s0, "count_change": F.col(part1) - F.col(part0)})


def composite_index(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """The mean of each group of columns, and ``composite``, the product of the means."""
    out = df.withColumns({g: sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols) for g, cols in groups.items()})
    product = F.lit(1.0)
    for g in groups:
        product = product * F.col(g)
    return out.withColumn("composite", product)


def share_of_parts(df: DataFrame, parts: list[str], total: str, out: str) -> DataFrame:
    """Percentage of ``total`` in the columns ``parts`` together.

    Absent columns and nulls count as 0; no total, or one that isn't above 0, gives null.
    """
    found = [F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in parts if p in df.columns]
    return df.withColumn(out, F.when(F.col(total) > 0, sum(found, F.lit(0.0)) / F.col(total) * 100))


def density(df: DataFrame, count: str, area: str, out: str) -> DataFrame:
    """``count`` for each unit of ``area``; null where the area isn't above 0."""
    return df.withColumn(out, F.when(F.col(area) > 0, F.col(count) / F.col(area)))
