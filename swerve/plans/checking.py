"""Queries of section 2.13: data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swerve.operators.aggregates import unpivot
from swerve.sources.tables import TURNS, read, turns

from .aggregating import R
from .registry import query

c = F.col


@query("dq_required_columns", "SELECT column_name AS missing FROM (SELECT 'l_orderkey' AS column_name UNION ALL SELECT 'l_depth' UNION ALL SELECT 'l_speed') WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE lineitem))")
def dq_required_columns(spark: SparkSession, d: str) -> DataFrame:
    have = read(spark, d, "lineitem").columns
    return spark.createDataFrame([(x,) for x in ("l_orderkey", "l_depth", "l_speed") if x not in have], "missing string")


@query("dq_range_assert", f"WITH {TURNS} SELECT grp, min(angle) >= 0 AND max(angle) <= 360 AS ok, count(*) FILTER (WHERE value NOT BETWEEN 0 AND 0.09) AS outside FROM t GROUP BY 1")
def dq_range_assert(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("grp").agg(((F.min("angle") >= 0) & (F.max("angle") <= 360)).alias("ok"), F.count_if(~c("value").between(0, 0.09)).alias("outside"))


@query("dq_unique_key", f"WITH {TURNS} SELECT play, line, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique_key(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("play", "line").agg(F.count("*").alias("n")).where("n > 1")


@query("dq_vocabulary", "SELECT c_mktsegment AS unexpected, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def dq_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "c_mktsegment string")
    return read(spark, d, "customer").join(F.broadcast(allowed), "c_mktsegment", "left_anti").groupBy(c("c_mktsegment").alias("unexpected")).agg(F.count("*").alias("n"))


@query("dq_functional_dependency", f"WITH {TURNS} SELECT play, count(DISTINCT setting) AS settings FROM t GROUP BY 1 HAVING count(DISTINCT setting) > 1")
def dq_functional_dependency(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("play").agg(F.countDistinct("setting").alias("settings")).where("settings > 1")


@query("dq_null_tests", f"WITH {TURNS}, n AS (SELECT *, nullif(angle, 13) IS NULL AS missing FROM t) SELECT missing, count(*) AS n, count(*) FILTER (WHERE value = 0) AS with_zero, count(*) FILTER (WHERE tax > 0.05) AS with_tax FROM n GROUP BY 1")
def dq_null_tests(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy(F.nullif("angle", F.lit(13)).isNull().alias("missing")).agg(F.count("*").alias("n"), F.count_if(c("value") == 0).alias("with_zero"), F.count_if(c("tax") > 0.05).alias("with_tax"))


@query("dq_inventory", "WITH f AS (SELECT 'supplier' AS name, count(*) AS rows, 4 AS columns FROM supplier UNION ALL SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'part', count(*), 6 FROM part), d AS (SELECT table_name, substr(column_name, 3) AS name, replace(replace(replace(data_type, 'VARCHAR', 'string'), 'INTEGER', 'int'), 'BIGINT', 'bigint') AS type FROM duckdb_columns() WHERE table_name IN ('supplier', 'customer')), s AS (SELECT name, lower(type) AS type FROM d WHERE table_name = 'supplier'), u AS (SELECT name, lower(type) AS type FROM d WHERE table_name = 'customer') SELECT 'file' AS kind, name, rows, columns, NULL AS supplier, NULL AS customer, NULL AS same FROM f UNION ALL SELECT 'column', coalesce(s.name, u.name), NULL, NULL, s.type, u.type, s.type IS NOT DISTINCT FROM u.type FROM s FULL JOIN u ON s.name = u.name")
def dq_inventory(spark: SparkSession, d: str) -> DataFrame:
    one = lambda n: (lambda t: t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows", F.lit(len(t.columns)).alias("columns")))(read(spark, d, n))
    files = one("supplier").union(one("customer")).union(one("part"))
    columns = lambda n: spark.createDataFrame([(k[2:], t) for k, t in read(spark, d, n).dtypes], f"name string, {n} string")
    pairs = columns("supplier").join(columns("customer"), "name", "full")
    none = lambda t: F.lit(None).cast(t)
    files = files.select(F.lit("file").alias("kind"), "name", "rows", "columns", none("string").alias("supplier"), none("string").alias("customer"), none("boolean").alias("same"))
    return files.union(pairs.select(F.lit("column"), "name", none("long"), none("int"), "supplier", "customer", F.col("supplier").eqNullSafe(F.col("customer"))))


@query("dq_reconcile_counts", f"WITH {TURNS}, a AS (SELECT season, count(*) AS n FROM t GROUP BY 1), b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n FROM orders GROUP BY 1) SELECT coalesce(a.season, b.season) AS season, a.n AS turns, b.n AS games FROM a FULL JOIN b ON a.season = b.season WHERE a.n IS DISTINCT FROM b.n")
def dq_reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    a = turns(spark, d).groupBy("season").agg(F.count("*").alias("turns"))
    b = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("season")).agg(F.count("*").alias("games"))
    return a.join(b, "season", "full").where(~c("turns").eqNullSafe(c("games")))


@query("dq_truncation_probe", f"WITH {TURNS}, p AS (SELECT play, count(*) AS rows, count(DISTINCT player) AS players FROM t GROUP BY 1) SELECT sum(rows)::BIGINT AS rows, count(*) AS plays, round(avg(players), 6) AS players_per_play, sum(rows) = 1048575 AS truncated FROM p")
def dq_truncation_probe(spark: SparkSession, d: str) -> DataFrame:
    p = turns(spark, d).groupBy("play").agg(F.count("*").alias("rows"), F.countDistinct("player").alias("players"))
    return p.agg(F.sum("rows").alias("rows"), F.count("*").alias("plays"), R(F.avg("players")).alias("players_per_play"), (F.sum("rows") == (1 << 20) - 1).alias("truncated"))


@query("dq_gate_table", f"WITH {TURNS}, g AS (SELECT count(*) FILTER (WHERE angle >= 30) / count(*)::DOUBLE AS sharp_share, avg(value) AS mean_value, max(tax) AS max_tax FROM t), l AS (UNPIVOT g ON sharp_share, mean_value, max_tax INTO NAME gate VALUE value), k AS (SELECT gate, value, CASE gate WHEN 'sharp_share' THEN 0.3 WHEN 'mean_value' THEN 0.06 ELSE 0.05 END::DOUBLE AS threshold FROM l) SELECT gate, round(value, 9) AS value, threshold, CASE WHEN value >= threshold THEN 'pass' ELSE 'fail' END AS status, CASE WHEN bool_or(gate = 'sharp_share' AND value < threshold) OVER () THEN 'stop' WHEN bool_or(value < threshold) OVER () THEN 'review' ELSE 'go' END AS verdict FROM k")
def dq_gate_table(spark: SparkSession, d: str) -> DataFrame:
    g = turns(spark, d).agg(F.avg((c("angle") >= 30).cast("double")).alias("sharp_share"), F.avg("value").alias("mean_value"), F.max("tax").alias("max_tax"))
    limit = F.when(c("gate") == "sharp_share", 0.3).when(c("gate") == "mean_value", 0.06).otherwise(0.05)
    verdict = F.when(c("sharp_share") < 0.3, "stop").when((c("mean_value") < 0.06) | (c("max_tax") < 0.05), "review").otherwise("go")  # the first that holds
    gates = unpivot(g.withColumn("verdict", verdict), ["verdict"], ["sharp_share", "mean_value", "max_tax"], "gate", "value")
    return gates.select("gate", R("value", 9).alias("value"), limit.alias("threshold"), F.when(c("value") >= limit, "pass").otherwise("fail").alias("status"), "verdict")
