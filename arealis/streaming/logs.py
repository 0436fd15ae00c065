"""Results over an append-only log, kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run_id string, stage string, event string, ts timestamp"


def stream_stage_status(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """Last start and end of each stage; write it with output mode ``update`` or ``complete``."""
    log = spark.readStream.schema(schema).json(path)
    last = lambda e: F.max(F.when(F.col("event") == e, F.col("ts")))
    out = log.groupBy("run_id", "stage").agg(last("stage_start").alias("started"), last("stage_end").alias("ended"))
    done = F.coalesce(F.col("ended") >= F.col("started"), F.lit(False))
    return out.withColumn("status", F.when(F.col("started").isNull(), "pending").when(done, "completed").otherwise("running"))


def stream_counts(spark: SparkSession, path: str, schema: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events of each hour; an hour closes once the log is ``late`` past it."""
    log = spark.readStream.schema(schema).parquet(path)
    log = log.withColumn(ts, F.col(ts).cast("timestamp"))  # event time needs a time zone
    return log.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("hour"), "events")
