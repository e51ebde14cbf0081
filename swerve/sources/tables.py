"""The driver's tables in the roles of the data model: turn rows, track frames, play records, dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, required: list[str] | None = None) -> DataFrame:
    """A table, pruned to the required columns; a missing one is named, not guessed."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if required:
        if missing := [c for c in required if c not in df.columns]:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        df = df.select(*required)
    return df


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn rows: keys play, line, player, part; setting, grp, the banded angle and measures."""
    c = F.col
    return read(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("play"), c("l_linenumber").alias("line"), c("l_suppkey").alias("player"), c("l_partkey").alias("part"),
        c("l_linestatus").alias("setting"), c("l_returnflag").alias("grp"), c("l_quantity").alias("angle"), c("l_discount").alias("value"),
        c("l_extendedprice").alias("price"), c("l_tax").alias("tax"), c("l_shipdate").alias("shipped"), F.year("l_shipdate").alias("season"),
    )


#: The same as SQL, for oracles.
TURNS = """t AS (SELECT l_orderkey AS play, l_linenumber AS line, l_suppkey AS player, l_partkey AS part, l_linestatus AS setting, l_returnflag AS grp,
 l_quantity AS angle, l_discount AS value, l_extendedprice AS price, l_tax AS tax, l_shipdate AS shipped, CAST(year(l_shipdate) AS INTEGER) AS season FROM lineitem)"""


def micros(ts: str):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track frames: track, id, us (microseconds), h (hours), label, position x and y."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("id"), micros("ts").alias("us"), F.col("event_type").alias("label"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y")).withColumn("h", F.col("us") / 3.6e9)


FRAMES = """e AS (SELECT user_id AS track, event_id AS id, epoch_us(ts) AS us, event_type AS label, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
 epoch_us(ts) / 3.6e9 AS h FROM events)"""
