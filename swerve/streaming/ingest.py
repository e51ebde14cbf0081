"""Streams of tracking files: each file converted once, repeated frames dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def convert_available(spark: SparkSession, src: str, dst: str, checkpoint: str, schema: str) -> DataFrame:
    """Convert the files that are there and were not converted yet; a second call takes only new ones."""
    stream = spark.readStream.schema(schema).option("header", True).csv(src)
    stream.writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(dst)


def distinct_frames(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated (track, time) frames; state is kept for the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, time])
