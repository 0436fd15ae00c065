"""Checks that return ``(check, status, message, value)`` rows with PASS, WARN or FAIL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.functions.geometry import is_valid


def _row(check: str, status: Column, message: Column, value: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), status.alias("status"), message.cast("string").alias("message"), value.cast("double").alias("value"))


def _rows(one: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _verdict(ok: Column, bad: str = "FAIL") -> Column:
    return F.when(ok, "PASS").otherwise(bad)


def check_rows(df: DataFrame, min_rows: int) -> DataFrame:
    n = F.col("n")
    return _rows(df.agg(F.count("*").alias("n")), [_row("row_count", _verdict(n >= min_rows), F.concat(n, F.lit(" rows")), n)])


def check_required(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """From the schema alone."""
    rows = [(f"required:{c}", "PASS" if c in df.columns else "FAIL", "present" if c in df.columns else "missing", float(c in df.columns)) for c in cols]
    return df.sparkSession.createDataFrame(rows, "check string, status string, message string, value double")


def check_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    ok = {c: kinds.get(c, "").split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") for c in cols}
    return df.sparkSession.createDataFrame([(f"numeric:{c}", "PASS" if ok[c] else "FAIL", kinds.get(c, "missing"), float(ok[c])) for c in cols], "check string, status string, message string, value double")


def check_nulls(df: DataFrame, cols: Sequence[str], warn_pct: float = 50.0) -> DataFrame:
    one = df.agg(*((100.0 * F.count_if(F.col(c).isNull()) / F.nullif(F.count("*"), F.lit(0))).alias(c) for c in cols))
    pct = {c: F.coalesce(c, F.lit(0.0)) for c in cols}
    return _rows(one, [_row(f"nulls:{c}", _verdict(p <= warn_pct, "WARN"), F.concat(F.format_number(p, 1), F.lit("% null")), F.round(p, 4)) for c, p in pct.items()])


def check_vector(df: DataFrame, srid: int, min_features: int, rings: str = "rings") -> DataFrame:
    """Reference system, number of features, null and invalid shapes."""
    none = F.col(rings).isNull() | (F.size(rings) == 0)
    one = df.agg(F.count("*").alias("n"), F.count_if(F.col("srid").isNull() | (F.col("srid") != srid)).alias("crs"), F.count_if(none).alias("empty"), F.count_if(~none & ~is_valid(F.col(rings))).alias("invalid"))
    c = F.col
    return _rows(one, [_row("crs", _verdict(c("crs") == 0), c("crs"), c("crs")), _row("features", _verdict(c("n") >= min_features), c("n"), c("n")), _row("empty", _verdict(c("empty") == 0, "WARN"), c("empty"), c("empty")), _row("invalid", _verdict(c("invalid") == 0), c("invalid"), c("invalid"))])


def gate(df: DataFrame, cols: Sequence[str], joined: str, max_null: float = 15.0, min_rate: float = 85.0) -> DataFrame:
    """What must hold before an analysis: nulls of key columns, and the share that a join matched."""
    one = df.agg(*((100.0 * F.count_if(F.col(c).isNull()) / F.count("*")).alias(f"n_{c}") for c in cols), (100.0 * F.count(joined) / F.count("*")).alias("rate"))
    rows = [_row(f"null_rate:{c}", _verdict(F.col(f"n_{c}") <= max_null), F.format_number(f"n_{c}", 1), F.round(f"n_{c}", 4)) for c in cols]
    return _rows(one, [*rows, _row("join_rate", _verdict(F.col("rate") >= min_rate), F.format_number("rate", 1), F.round("rate", 4))])


def overall(checks: DataFrame) -> DataFrame:
    """FAIL if any check fails, else WARN if any warns, else PASS."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checks.agg(n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"), F.when(n("FAIL") > 0, "FAIL").when(n("WARN") > 0, "WARN").otherwise("PASS").alias("overall"))


def quality_points(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Points for data quality, 30 at most: ten each for a layer, numeric columns and under 20% of null cells."""
    null = reduce(Column.__add__, (F.count_if(F.col(c).isNull()) for c in numeric)) if numeric else F.lit(None).cast("long")
    pct = F.coalesce(100.0 * null / F.nullif(F.count("*") * len(numeric), F.lit(0)), F.lit(0.0))
    # Points and the limit of null cells.
    points = 10 + (10 + F.when(pct < 20, 10).otherwise(0) if numeric else F.lit(0))
    return df.agg(points.cast("int").alias("points"), F.lit(30).alias("possible"), F.round(pct, 1).alias("null_pct"))


def grade(score: Column) -> Column:
    """A letter for a score out of a hundred: A from 90, B from 80, C from 70, D from 60, else F."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").when(score.isNotNull(), "F")


def check_contract(log: DataFrame, required: Mapping[str, Sequence[str]], kind: str = "kind", payload: str = "payload") -> DataFrame:
    """JSON records with the fields that their kind lacks."""
    missing = F.array().cast("array<string>")
    for k, fields in required.items():
        lacks = F.array_compact(F.array(*(F.when(F.get_json_object(payload, f"$.{f}").isNull(), F.lit(f)) for f in fields)))
        missing = F.when(F.col(kind) == k, lacks).otherwise(missing)
    known = F.col(kind).isin(*required)
    return log.withColumn("missing", F.array_join(missing, ",")).withColumn("status", F.when(~known, "WARN").when(F.col("missing") == "", "PASS").otherwise("FAIL"))
