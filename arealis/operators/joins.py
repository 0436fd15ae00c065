"""Joins on keys, with what they matched."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def join_data(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """Equi-join of text keys; a null key matches nothing, duplicate keys fan out.

    The right key is dropped; other columns of both sides get ``_x`` and ``_y``.
    """
    both = (set(left.columns) & set(right.columns)) - {left_key, right_key}
    a = left.withColumnsRenamed({c: f"{c}_x" for c in both}).withColumn("_lk", F.col(left_key).cast("string"))
    b = right.withColumnsRenamed({c: f"{c}_y" for c in both}).withColumn("_rk", F.col(right_key).cast("string")).drop(right_key)
    return a.join(b, F.col("_lk") == F.col("_rk"), how).drop("_lk", "_rk")


def join_diagnostics(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: rows, unique keys, matched, left only, right only, duplicated keys, match % of left keys."""
    a = left.groupBy(F.col(left_key).cast("string").alias("k")).agg(F.count("*").alias("nl")).where("k is not null")
    b = right.groupBy(F.col(right_key).cast("string").alias("k")).agg(F.count("*").alias("nr")).where("k is not null")
    both = F.count_if(F.expr("nl is not null and nr is not null"))
    return a.join(b, "k", "full_outer").agg(
        F.coalesce(F.sum("nl"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("nr"), F.lit(0)).alias("right_rows"),
        F.count("nl").alias("left_keys"),
        F.count("nr").alias("right_keys"),
        both.alias("matched"),
        F.count_if(F.expr("nr is null")).alias("left_only"),
        F.count_if(F.expr("nl is null")).alias("right_only"),
        F.count_if(F.expr("nr > 1")).alias("right_duplicates"),
        F.round(100.0 * both / F.nullif(F.count("nl"), F.lit(0)), 2).alias("match_pct"),
    )


def batch_join(base: DataFrame, tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Left joins one after another; a colliding column gets its table's name in front."""
    for name, t in tables.items():
        if key not in t.columns:
            log.warning("table %s has no %s", name, key)
            continue
        t = t.withColumnsRenamed({c: f"{name}_{c}" for c in t.columns if c != key and c in base.columns})
        t = t.withColumn("_rk", F.col(key).cast("string")).drop(key)
        base = base.join(t, F.col(key).cast("string") == F.col("_rk"), "left").drop("_rk")
    return base


def join_coverage(df: DataFrame, key: str, fields: Sequence[str], expected: int | None = None) -> DataFrame:
    """One row: rows, unique keys, whether they repeat, share with any field, share of each field."""
    n = F.count("*")
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.nullif(n, F.lit(0)), 2)
    some = F.coalesce(*(F.col(f).cast("string") for f in fields)).isNotNull()
    return df.agg(
        n.alias("rows"),
        F.count_distinct(key).alias("unique_keys"),
        (F.count_distinct(key) == F.count(key)).alias("key_unique"),
        pct(some).alias("any_pct"),
        *(pct(F.col(f).isNotNull()).alias(f"{f}_pct") for f in fields),
        *([(n == expected).alias("as_expected")] if expected is not None else []),
    )


def brand_match(df: DataFrame, brands: DataFrame, name: str, most: int = 5000) -> DataFrame:
    """The brand of each name: equal, equal without case, one inside the other, equal without punctuation.

    ``brands`` (``ordinal``, ``brand``) is a list to choose from, of at most ``most`` rows:
    it goes into the plan as values, so each distinct name is matched in one pass without
    a join. The first of the best tier wins.
    """
    listed = brands.orderBy("ordinal").limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} brands")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    def tier(n: Column, b: Column) -> Column:
        return F.when(n == b, 1).when(F.lower(n) == F.lower(b), 2).when(F.lower(n).contains(F.lower(b)) | F.lower(b).contains(F.lower(n)), 3).when(plain(n) == plain(b), 4)

    values = F.array(*(F.struct(F.lit(r.ordinal).alias("ordinal"), F.lit(r.brand).alias("brand")) for r in listed))
    tried = F.transform(values, lambda v: F.struct(tier(F.col(name), v.brand).alias("tier"), v.ordinal.alias("ordinal"), v.brand.alias("brand")))
    best = F.array_min(F.filter(tried, lambda v: v.tier.isNotNull()))
    names = df.select(name).distinct().select(name, best.alias("m")).select(name, "m.brand", "m.tier")
    return df.join(names, name, "left")


def coalesce_match(df: DataFrame, primary: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` from ``primary``, else from ``fallback``, and which of them gave it."""
    a, b = primary.select(key, F.col(value).alias("_a")), fallback.select(key, F.col(value).alias("_b"))
    out = df.join(a, key, "left").join(b, key, "left")
    source = F.when(F.col("_a").isNotNull(), "primary").when(F.col("_b").isNotNull(), "fallback").otherwise("none")
    return out.withColumns({value: F.coalesce("_a", "_b"), "source": source}).drop("_a", "_b")


def normalize_category(df: DataFrame, mapping: DataFrame, column: str, other: str = "other") -> DataFrame:
    """``mapping(raw, category, action)``: unmapped rows get ``other`` and are escalated, excluded ones go."""
    m = mapping.select(F.col("raw").alias("_raw"), "category", "action")
    out = df.join(m, F.col(column) == F.col("_raw"), "left").drop("_raw")
    out = out.withColumns({"category": F.coalesce("category", F.lit(other)), "action": F.coalesce("action", F.lit("escalate"))})
    return out.where("action != 'exclude'")


def orphan_refs(log_rows: DataFrame, id_col: str, ref_col: str) -> DataFrame:
    """References that no row answers."""
    ids = log_rows.select(F.col(id_col).alias("_id")).distinct()
    return log_rows.where(F.col(ref_col).isNotNull()).join(ids, F.col(ref_col) == F.col("_id"), "left_anti")


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Rows of two sources side by side with their issue: missing on a side, mismatch, or none."""
    x, y = a.select(key, F.col(value).alias("left_value")), b.select(key, F.col(value).alias("right_value"))
    l, r = F.col("left_value"), F.col("right_value")
    issue = F.when(l.isNull(), "missing_left").when(r.isNull(), "missing_right").when(F.abs(l - r) > tolerance, "mismatch").when((l == 0) & (r == 0), "zero").otherwise("ok")
    return x.join(y, key, "full_outer").withColumn("issue", issue)


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key once with the side it is on: both, left or right."""
    x = a.select(key).distinct().withColumn("_l", F.lit(True))
    y = b.select(key).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return x.join(y, key, "full_outer").select(key, side.alias("side"))


def union_layers(dfs: Sequence[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def latest(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
