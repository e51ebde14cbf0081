"""Queries of section 2.14: streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swerve.sources.tables import read
from swerve.streaming import ingest

from .registry import query
from .scans import work_dir


@query("stream_ingest_available_now", "SELECT event_id, user_id, value FROM events")
def stream_ingest_available_now(spark: SparkSession, d: str) -> DataFrame:
    root, schema = work_dir(spark), "event_id long, user_id long, value double"
    e = read(spark, d, "events").select("event_id", "user_id", "value")
    for part in (0, 1):  # a second batch of files arrives after the first was taken
        e.where(F.col("event_id") % 2 == part).write.mode("append").csv(f"{root}/in", header=True)
        out = ingest.convert_available(spark, f"{root}/in", f"{root}/out", f"{root}/state", schema)
    return out


@query("stream_frame_dedupe", "SELECT user_id AS track, count(DISTINCT ts) AS frames FROM events GROUP BY 1")
def stream_frame_dedupe(spark: SparkSession, d: str) -> DataFrame:
    root, schema = work_dir(spark), "track long, ts timestamp"
    e = read(spark, d, "events").select(F.col("user_id").alias("track"), F.col("ts").cast("timestamp").alias("ts"))
    e.union(e).write.parquet(f"{root}/in")
    frames = ingest.distinct_frames(spark.readStream.schema(schema).parquet(f"{root}/in"), ["track"], "ts", "36500 days")
    frames.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out").groupBy("track").agg(F.count("*").alias("frames"))
