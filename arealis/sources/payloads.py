"""Payloads of public data services shaped into tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_header_array(df: DataFrame, body: str, fields: Sequence[str], geo: Sequence[str]) -> DataFrame:
    """``[[names], [values], …]`` as rows with ``geoid`` from the ``geo`` columns; ``fields`` names the payload's columns."""
    rows = df.select(F.posexplode(F.from_json(body, "array<array<string>>")).alias("_n", "_v"), F.get(F.from_json(body, "array<array<string>>"), F.lit(0)).alias("_h")).where("_n > 0")
    cell = lambda f: F.get("_v", (F.array_position("_h", f) - 1).cast("int"))
    return rows.select(*(cell(f).alias(f) for f in fields)).withColumn("geoid", F.concat(*geo)).orderBy(*geo)


def from_series(df: DataFrame, body: str) -> DataFrame:
    """``{seriesID, data:[{year, period, value, footnotes:[{text}]}]}`` objects as observations."""
    kind = "array<struct<seriesID:string, data:array<struct<year:string, period:string, value:string, footnotes:array<struct<text:string>>>>>>"
    s = df.select(F.explode(F.from_json(body, kind)).alias("s")).select(F.col("s.seriesID").alias("series"), F.explode("s.data").alias("d"))
    notes = F.array_join(F.filter(F.transform("d.footnotes", lambda f: f.text), lambda t: t.isNotNull() & (t != "")), "; ")
    return s.select("series", F.col("d.year").try_cast("int").alias("year"), "d.period", F.col("d.value").try_cast("double").alias("value"), F.coalesce(notes, F.lit("")).alias("footnotes"))


def from_records(df: DataFrame, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """Fixed columns, each from the first of its source columns that exists and isn't null."""
    pick = lambda names: F.coalesce(*(F.col(n) for n in names if n in df.columns), F.lit(None))
    return df.select(*(pick(names).alias(out) for out, names in mapping.items()))


def from_osm(df: DataFrame, body: str) -> DataFrame:
    """Elements as places: ways by their centre, tags as a map, elements without coordinates left out."""
    kind = "struct<elements:array<struct<type:string, id:bigint, lat:double, lon:double, center:struct<lat:double, lon:double>, tags:map<string,string>>>>"
    e = df.select(F.explode(F.from_json(body, kind).getField("elements")).alias("e"))
    out = e.select(F.col("e.id").alias("id"), F.col("e.type").alias("kind"), F.coalesce("e.lon", "e.center.lon").alias("x"), F.coalesce("e.lat", "e.center.lat").alias("y"), F.element_at("e.tags", "name").alias("name"), F.element_at("e.tags", "amenity").alias("amenity"), F.element_at("e.tags", "shop").alias("shop"), F.col("e.tags").alias("tags"))
    return out.where("x is not null and y is not null")


def read_lodes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Job files: ``wac`` and ``rac`` by block, ``od`` by pair of blocks; ids stay text."""
    df = spark.read.csv(path, header=True)
    ids = {"wac": ["w_geocode"], "rac": ["h_geocode"], "od": ["w_geocode", "h_geocode"]}[kind]
    return df.withColumns({c: F.col(c).try_cast("long") for c in df.columns if c not in ids and c != "createdate"})


def gtfs_stats(agency: DataFrame, routes: DataFrame, stops: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row: agencies, routes, stops and the range of service days."""
    days = calendar.agg(F.min("start_date").alias("first_day"), F.max("end_date").alias("last_day"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    names = agency.agg(F.array_join(F.array_sort(F.collect_set("agency_name")), "; ").alias("agencies"))
    return names.join(n(routes, "routes")).join(n(stops, "stops")).join(days)
