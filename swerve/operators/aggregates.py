"""Aggregates that are more than one function call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def supply_and_demand(df: DataFrame, setting: str, group: str, band: Column, supply: str, demand: str) -> DataFrame:
    """Counts and shares per band in two settings side by side, and the ratio of the shares.

    Shares are of all rows of the setting and group that have a band; an absent band counts 0.
    """
    n = df.select(F.col(setting).alias("_s"), F.col(group).alias("grp"), band.alias("band")).where("band is not null")
    wide = n.groupBy("grp", "band").agg(F.count_if(F.col("_s") == supply).alias("n_supply"), F.count_if(F.col("_s") == demand).alias("n_demand"))
    whole = Window.partitionBy("grp")
    share = lambda c: F.when(F.sum(c).over(whole) > 0, F.col(c) / F.sum(c).over(whole))
    wide = wide.withColumn("share_supply", share("n_supply")).withColumn("share_demand", share("n_demand"))
    return wide.withColumn("share_ratio", F.when(F.col("share_supply") > 0, F.col("share_demand") / F.col("share_supply")))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each key; of equally common ones the smallest."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def histogram(df: DataFrame, keys: list[str], value: str, lo: float, width: float, bins: int) -> DataFrame:
    """Counts in fixed bins, the last one closed at both ends; other values are left out."""
    hi = lo + width * bins
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    return df.where((F.col(value) >= lo) & (F.col(value) <= hi)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
