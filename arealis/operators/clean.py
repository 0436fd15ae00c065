"""Cleaning of tables: names, selection, types, filters."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.functions.columns import clean_name

log = logging.getLogger(__name__)


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*map(clean_name, df.columns))


def select_fields(df: DataFrame, fields: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """Chosen columns in the order asked for; missing ones are skipped with a warning."""
    for f in fields:
        if f not in df.columns:
            log.warning("no column %s", f)
    chosen = [f for f in fields if f in df.columns]
    return df.select(*chosen, *(a for a in always if a in df.columns and a not in chosen))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def coerce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns whose every value allows it; one bad value leaves a column as it was."""
    known = {c: t for c, t in types.items() if c in df.columns}
    if not known:
        return df
    bad = df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in known.items())).first()
    for c in known:
        if bad[c]:
            log.warning("%s keeps its type: %d values don't fit", c, bad[c])
    return df.withColumns({c: F.col(c).cast(t) for c, t in known.items() if not bad[c]})


def where(df: DataFrame, condition: str | Column) -> DataFrame:
    return df.filter(condition)


def derive(df: DataFrame, specs: Sequence[str]) -> DataFrame:
    """``name=expression`` columns in order; one that can't be resolved is skipped with a warning."""
    for spec in specs:
        name, _, expression = spec.partition("=")
        try:
            df = df.withColumn(name.strip(), F.expr(expression))
            df.schema  # noqa: B018  resolves the plan
        except AnalysisException as e:
            log.warning("%s skipped: %s", name, e)
    return df


def poi_filter(df: DataFrame, brands: Sequence[str] = (), amenities: Sequence[str] = (), shops: Sequence[str] = (), exclude: Sequence[str] = (), condition: str | None = None, any_of: bool = False) -> DataFrame:
    """Places by name, brand or operator, amenity, shop and a raw condition.

    Clauses are AND-ed, or OR-ed with ``any_of``; exclusions always apply and keep
    places without a brand.
    """
    clauses = []
    if brands:
        clauses.append(reduce(Column.__or__, (F.coalesce(F.col(c).ilike(f"%{b}%"), F.lit(False)) for b in brands for c in ("name", "brand", "operator") if c in df.columns)))
    if amenities:
        clauses.append(F.col("amenity").isin(*amenities))
    if shops:
        clauses.append(F.col("shop").isin(*shops))
    if condition:
        clauses.append(F.expr(condition))
    if clauses:
        df = df.filter(reduce(Column.__or__ if any_of else Column.__and__, clauses))
    for b in exclude:
        df = df.filter(reduce(Column.__and__, (~F.coalesce(F.col(c).ilike(f"%{b}%"), F.lit(False)) for c in ("name", "brand") if c in df.columns)))
    return df


def in_bbox(df: DataFrame, bbox: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    xmin, ymin, xmax, ymax = bbox
    return df.filter(F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax))


def points(df: DataFrame, lon: str, lat: str, srid: int = 4326) -> DataFrame:
    """Point rows; those without both coordinates go."""
    return df.na.drop(subset=[lon, lat]).withColumns({"x": F.col(lon).cast("double"), "y": F.col(lat).cast("double"), "srid": F.lit(srid)})


def drop_empty_geom(df: DataFrame, column: str = "rings") -> DataFrame:
    """Rows with a shape; a metric of the same name counts those dropped."""
    empty = F.col(column).isNull() | (F.size(column) == 0)
    return df.observe("drop_empty_geom", F.count_if(empty).alias("dropped")).filter(~empty)


def flag_institutional(df: DataFrame, name: str, poverty: str | None = None) -> DataFrame:
    """Flag places whose name or poverty rate points to students, prisoners or soldiers."""
    # Words that mark such places.
    found = F.lower(name).rlike("university|college|prison|correctional|penitentiary|military|air force|fort|naval|army|marine|hospital|reservation")
    if poverty:
        found = found | (F.col(poverty) > 60)
    return df.withColumn("institutional", F.coalesce(found, F.lit(False)))


def with_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Rows whose text id begins with ``prefix``, as a state's code; the scan gets the condition."""
    return df.where(F.startswith(F.col(col), F.lit(prefix)))
