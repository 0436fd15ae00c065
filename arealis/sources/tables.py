"""Reading and writing tables and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, as_string: bool = False) -> DataFrame:
    """CSV, TSV, JSON or Parquet by suffix (``.gz`` allowed).

    Without a schema, CSV columns stay text when ``as_string`` is set and are inferred
    otherwise; ids with leading zeros need a schema or ``as_string``.
    """
    kind = path.removesuffix("/").removesuffix(".gz").rpartition(".")[2].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("csv", "tsv", "txt"):
        return reader.csv(path, header=True, sep="," if kind == "csv" else "\t", inferSchema=schema is None and not as_string)
    if kind == "json":
        return reader.json(path, multiLine=True)
    if kind in ("jsonl", "ndjson"):
        return reader.json(path)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    kind = path.removesuffix("/").rpartition(".")[2].lower()
    w = df.write.mode(mode)
    if kind in ("csv", "tsv"):
        w.csv(path, header=True, sep="," if kind == "csv" else "\t")
    elif kind in ("json", "jsonl"):
        w.json(path)
    else:
        w.parquet(path)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Polygon features as ``(fid, part, <properties>, rings)``; ``properties`` is a DDL list of fields."""
    ring = "array<array<array<double>>>"
    feature = f"struct<type:string, properties:struct<{', '.join(p.strip().replace(' ', ':', 1) for p in properties.split(','))}>, geometry:struct<type:string, coordinates:string>>"
    raw = spark.read.schema(f"features array<{feature}>").json(path, multiLine=True)
    f = raw.select(F.posexplode("features").alias("fid", "f"))
    coords = F.col("f.geometry.coordinates")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(coords, ring))).otherwise(F.from_json(coords, f"array<{ring}>"))
    rows = f.select("fid", "f.properties.*", F.posexplode(parts).alias("part", "_p"))
    points = F.transform("_p", lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    # a closed ring repeats its first point
    open_ = F.transform(points, lambda r: F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r))
    return rows.withColumn("rings", open_).drop("_p")


def read_layer(spark: SparkSession, url: str, table: str, where: str | None = None, properties: dict[str, str] | None = None, key: str | None = None, parts: int = 16) -> DataFrame:
    """A database layer; Spark sends the condition and the columns asked for to the server.

    With a whole-number or date column ``key`` the table is read in ``parts`` queries at
    once, each over a range of it; its ends are asked of the server first, and rows
    without a key come with the first range. Without ``key`` one task reads it all.
    """
    options = properties or {}
    if key is None:
        df = spark.read.jdbc(url, table, properties=options)
        return df.where(where) if where else df
    ends = spark.read.jdbc(url, table, properties=options).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if ends.lo is None:
        return read_layer(spark, url, table, where, properties)
    df = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(ends.lo), upperBound=str(ends.hi), numPartitions=str(parts), **options).load()
    return df.where(where) if where else df


def run_sql(spark: SparkSession, sql: str, **layers: DataFrame) -> DataFrame:
    """A SELECT over the given layers."""
    return spark.sql(sql, **layers)


def read_places(spark: SparkSession, root: str, theme: str, kind: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Rows of a ``theme=/type=`` partitioned layer whose box meets ``bbox``; all of it is pushed to the scan."""
    xmin, ymin, xmax, ymax = bbox
    df = spark.read.parquet(root)
    return df.where((F.col("theme") == theme) & (F.col("type") == kind) & (F.col("bbox.xmin") <= xmax) & (F.col("bbox.xmax") >= xmin) & (F.col("bbox.ymin") <= ymax) & (F.col("bbox.ymax") >= ymin))


def write_layers(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each ``layer``."""
    df.write.mode(mode).partitionBy("layer").parquet(path)


def save_layer(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Save a layer as a table and put its description into ``layer_registry``."""
    spark = df.sparkSession
    df.write.mode(mode).saveAsTable(name)
    saved = spark.table(name)
    boxed = {"xmin", "ymin", "xmax", "ymax"} <= set(saved.columns)
    ends = [F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")] if boxed else [F.lit(None)] * 4
    row = saved.agg(F.count("*").alias("n"), *(e.cast("double").alias(c) for e, c in zip(ends, ("xmin", "ymin", "xmax", "ymax"))))
    kind = "polygon" if "rings" in saved.columns else "line" if "pts" in saved.columns else "point" if "x" in saved.columns else "table"
    row = row.select(F.lit(name).alias("name"), F.lit(kind).alias("geometry_type"), "n", "xmin", "ymin", "xmax", "ymax", F.current_timestamp().alias("loaded_at"))
    row.write.mode("append").saveAsTable("layer_registry")


def layers(spark: SparkSession) -> DataFrame:
    """The newest description of each layer that exists, newest first."""
    names = [t.name for t in spark.catalog.listTables()]
    last = spark.table("layer_registry").where(F.col("name").isin(names)).groupBy("name").agg(F.max(F.struct("loaded_at", "geometry_type", "n", "xmin", "ymin", "xmax", "ymax")).alias("m"))
    return last.select("name", "m.*").orderBy(F.desc("loaded_at"), "name")


def drop_layer(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def inspect(df: DataFrame) -> DataFrame:
    """One row: rows, columns, types, and total bounds where there are boxes or points."""
    cols = ("xmin", "ymin", "xmax", "ymax") if "xmin" in df.columns else ("x", "y", "x", "y")
    boxed = set(cols) <= set(df.columns)
    ends = [f(c).cast("double") if boxed else F.lit(None).cast("double") for f, c in zip((F.min, F.min, F.max, F.max), cols)]
    return df.agg(F.count("*").alias("rows"), *(e.alias(n) for e, n in zip(ends, ("xmin", "ymin", "xmax", "ymax")))).select("rows", F.lit(len(df.columns)).alias("columns"), F.lit(", ".join(f"{c}:{t}" for c, t in df.dtypes)).alias("types"), "xmin", "ymin", "xmax", "ymax")


def audit(df: DataFrame, step: str) -> tuple[DataFrame, object]:
    """``df`` with an observation of its rows and nulls, to read after an action and append to a run log."""
    from pyspark.sql import Observation

    seen = Observation(step)
    return df.observe(seen, F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns)), seen


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``| factor | weight | direction |`` of a markdown table."""
    cells = F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|")
    rows = spark.read.text(path).where("value like '%|%|%'").select(*(F.trim(F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(("factor", "weight", "direction"))))
    return rows.withColumn("weight", F.col("weight").try_cast("double")).where("weight is not null")
