"""Reading and writing: null tokens, bad casts, pruning, stamping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType


def csv_with_null_token(spark: SparkSession, path: str, schema: str, token: str = "NA") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, nullValue=token)


def csv_try_cast(spark: SparkSession, path: str, types: dict[str, str], token: str = "NA") -> DataFrame:
    """Every column as text, null tokens NA and empty, then cast one by one; a bad value is null."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in types)).csv(path, header=True, nullValue=token)
    return raw.select(*[F.expr(f"try_cast(nullif({c}, '') AS {t})").alias(c) for c, t in types.items()])


def csv_to_parquet_once(spark: SparkSession, src: str, dst: str, schema: str, by: list[str]) -> DataFrame:
    """The converted table; nothing is written where it is there already."""
    spark.read.schema(schema).csv(src, header=True).write.mode("ignore").option("compression", "zstd").partitionBy(*by).parquet(dst)
    return spark.read.schema(schema).parquet(dst)


def scan_with_season(spark: SparkSession, path: str, schema: str, games: DataFrame, key: str, game_key: str) -> DataFrame:
    """Season from the file's name, else from the game table, else null."""
    named = spark.read.schema(schema).csv(path).withColumn("in_name", F.regexp_extract(F.input_file_name(), r"game_(20\d\d|19\d\d)", 1).try_cast("int"))
    g = games.select(F.col(game_key).alias("_game"), F.col("season").alias("in_games"))
    return named.join(g, named[key] == g["_game"], "left").withColumn("season", F.coalesce("in_name", "in_games")).drop("in_name", "in_games", "_game")


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def needed_rows(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def stamped(df: DataFrame, stamps: dict[str, str], schema: str) -> DataFrame:
    """Leading constant columns, then the table, cast to a fixed schema."""
    wide = df.select(*[F.lit(v).alias(k) for k, v in stamps.items()], "*")
    target = StructType.fromDDL(schema)
    return wide.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target])


def finite(df: DataFrame) -> DataFrame:
    """Numbers that are not finite become null."""
    number = (T.DoubleType, T.FloatType)
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.select(*[F.when(~bad(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, number) else F.col(f.name) for f in df.schema])
