"""Queries that run as streams over what is there, until all of it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.plans.registry import Tables, query
from arealis.sources.shared import shared_dir
from arealis.streaming.logs import LOG, stream_counts, stream_stage_status


def _drained(t: Tables, stream: DataFrame) -> DataFrame:
    """The state of a stream once it has read its input; each batch replaces the result."""
    path = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    put(t.spark.createDataFrame([], schema), -1)  # for a stream without input
    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return t.spark.read.schema(schema).parquet(f"{path}/out")


@query("SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY 1")
def stream_hourly_counts(t: Tables) -> DataFrame:
    counts = stream_counts(t.spark, f"{t.sf_dir}/events.parquet*", t.events.schema)
    return _drained(t, counts).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "events")


@query("""
WITH a AS (SELECT user_id AS run_id, event_type AS stage, max(ts) FILTER (WHERE event_id % 2 = 0) started, max(ts) FILTER (WHERE event_id % 2 = 1) ended FROM events GROUP BY 1, 2)
SELECT CAST(run_id AS VARCHAR) AS run_id, stage, CASE WHEN started IS NULL THEN 'pending' WHEN coalesce(ended >= started, false) THEN 'completed' ELSE 'running' END AS status FROM a""")
def stream_stages(t: Tables) -> DataFrame:
    path = f"{shared_dir(t.spark)}/log-{uuid.uuid4().hex}"
    event = F.when(F.col("event_id") % 2 == 0, "stage_start").otherwise("stage_end")
    t.events.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("stage"), event.alias("event"), "ts").write.json(path)
    return _drained(t, stream_stage_status(t.spark, path, LOG)).select("run_id", "stage", "status")
