"""Queries of section 2.1: sources, sinks, conversion."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swerve.operators import scans as S
from swerve.sources.tables import TURNS, read, turns

from .registry import query


def work_dir(spark: SparkSession) -> str:
    """A new folder that all executors share. A cluster must name it; one process may do with a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="swerve-")
    return f"{base.rstrip('/')}/swerve-{uuid.uuid4().hex}"


@query("csv_scan_null_token", "SELECT s_suppkey, nullif(s_nationkey, 3) AS s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def csv_scan_null_token(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark)
    read(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") != 3, F.col("s_nationkey")).alias("s_nationkey"), F.round("s_acctbal", 2).alias("s_acctbal")).write.csv(path, header=True, nullValue="NA")
    return S.csv_with_null_token(spark, path, "s_suppkey long, s_nationkey int, s_acctbal double")


@query("csv_all_string_try_cast", "SELECT c_custkey, nullif(c_nationkey, 5) AS c_nationkey, round(c_acctbal, 2) AS c_acctbal, CAST(NULL AS BIGINT) AS bad FROM customer")
def csv_all_string_try_cast(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark)
    c = read(spark, d, "customer")
    c.select(F.col("c_custkey").cast("string").alias("c_custkey"), F.when(F.col("c_nationkey") != 5, F.col("c_nationkey").cast("string")).otherwise("NA").alias("c_nationkey"), F.round("c_acctbal", 2).cast("string").alias("c_acctbal"), F.col("c_mktsegment").alias("bad")).write.csv(path, header=True)
    return S.csv_try_cast(spark, path, {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double", "bad": "bigint"})


@query("csv_to_parquet_once", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def csv_to_parquet_once(spark: SparkSession, d: str) -> DataFrame:
    src, dst = work_dir(spark), work_dir(spark)
    read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.csv(src, header=True)
    S.csv_to_parquet_once(spark, src, dst, "o_orderkey long, o_custkey long, o_orderstatus string", ["o_orderstatus"])
    return S.csv_to_parquet_once(spark, src, dst, "o_orderkey long, o_custkey long, o_orderstatus string", ["o_orderstatus"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("multi_file_scan_with_season", "SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY 1")
def multi_file_scan_with_season(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark)
    o = read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"))
    games = o.select(F.col("o_orderkey").alias("game"), "season")
    o.withColumn("file", F.when(F.col("season") % 2 == 0, F.concat(F.lit("game_"), F.col("season"))).otherwise("game_other")).select("o_orderkey", "file").write.partitionBy("file").csv(path)
    scanned = S.scan_with_season(spark, path, "o_orderkey long, file string", games, "o_orderkey", "game")
    return scanned.groupBy("season").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("parquet_scan_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def parquet_scan_pruned(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem", ["l_orderkey", "l_quantity"]).where("l_quantity >= 45")


@query("union_by_name_scan", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def union_by_name_scan(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return S.union_by_name([nation, read(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))])


@query("partitioned_scan_by_key", f"WITH {TURNS} SELECT season, grp, count(*) AS n FROM t WHERE season IN (1995, 1996) GROUP BY 1, 2")
def partitioned_scan_by_key(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark)
    turns(spark, d).select("season", "grp", "angle").write.partitionBy("season").parquet(path)
    return spark.read.schema("grp string, angle double, season int").parquet(path).where(F.col("season").isin(1995, 1996)).groupBy("season", "grp").agg(F.count("*").alias("n"))


@query("needed_key_extraction", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def needed_key_extraction(spark: SparkSession, d: str) -> DataFrame:
    keys = read(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"))
    return S.needed_rows(read(spark, d, "lineitem"), keys, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("stamped_write", "SELECT 'sample' AS provenance, 'lineitem' AS label, l_orderkey, CAST(l_quantity AS FLOAT) AS l_quantity FROM lineitem")
def stamped_write(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark)
    schema = "provenance string, label string, l_orderkey long, l_quantity float"
    S.stamped(read(spark, d, "lineitem"), {"provenance": "sample", "label": "lineitem"}, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@query("run_manifest_counts", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(NULL AS DOUBLE) AS bad FROM orders GROUP BY 1")
def run_manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return S.finite(o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.avg(F.lit(float("nan"))).alias("bad")))
