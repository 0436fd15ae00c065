"""Where queries register themselves with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name; ``sql`` is the same query for DuckDB."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def select6(df: DataFrame, *keys: str, **numbers: str) -> DataFrame:
    """Keys as they are, other columns rounded to six places."""
    rest = [c for c in df.columns if c not in keys]
    kinds = dict(df.dtypes)
    return df.select(*keys, *(r6(c) if kinds[c] == "double" else F.col(c) for c in rest))
