"""Joins that need care: guarded, tolerant in time, nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_on(df: DataFrame, keys: list[str]) -> bool:
    return df.groupBy(*keys).count().where("count > 1").limit(1).count() == 0


def left_guarded(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that can't fan out: keys that the right side repeats are an error."""
    if not unique_on(right, keys):
        raise ValueError(f"{', '.join(keys)} repeats on the right side")
    return left.join(right, keys, "left")


def within_time(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, tolerance: float) -> DataFrame:
    """Rows with equal keys whose times differ by at most the tolerance.

    Time is cut into buckets as wide as the tolerance, and the right side stands in its own bucket
    and both neighbours, so that the join is on keys and bucket and a long track is cut up.
    """
    a = left.withColumn("_bucket", F.floor(F.col(left_t) / tolerance))
    b = right.withColumn("_at", F.floor(F.col(right_t) / tolerance)).withColumn("_bucket", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1))).drop("_at")
    return a.join(b, [*keys, "_bucket"]).where(F.abs(F.col(left_t) - F.col(right_t)) <= tolerance).drop("_bucket")


def within_cells(left: DataFrame, right: DataFrame, keys: list[str], left_xy: tuple[str, str], right_xy: tuple[str, str], gate: float) -> DataFrame:
    """Rows with equal keys whose points may lie within the gate of one another: all that do, and some more.

    The plane is cut into cells a little wider than the gate, and the right side stands in its own
    cell and the eight around it, so that the join is on keys and cell.
    """
    cell = lambda v: F.floor(F.col(v) / (gate * 1.001)).cast("long")
    near = lambda v: F.explode(F.sequence(cell(v) - 1, cell(v) + 1))
    a = left.withColumn("_cx", cell(left_xy[0])).withColumn("_cy", cell(left_xy[1]))
    b = right.withColumn("_cx", near(right_xy[0])).withColumn("_cy", near(right_xy[1]))
    return a.join(b, [*keys, "_cx", "_cy"]).drop("_cx", "_cy")


def nearest(pairs: DataFrame, keys: list[str], distance: Column, ties: list[str], gate: float | None = None) -> DataFrame:
    """The nearest candidate of each key, ties by the given columns; beyond the gate there is none."""
    ranked = pairs.withColumn("distance", distance).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", *ties)))
    best = ranked.where("_n = 1").drop("_n")
    return best if gate is None else best.where(F.col("distance") <= gate)
