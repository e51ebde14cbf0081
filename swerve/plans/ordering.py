"""Queries of sections 2.5 and 2.6: windows, sorting, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swerve.sources.tables import FRAMES, TURNS, frames, read, turns

from .aggregating import R, cells
from .registry import query

c = F.col
K = ["play", "line", "player", "part"]
W = "WINDOW w AS (PARTITION BY track ORDER BY us, id)"


def in_track(*more: str) -> Window:
    """The order of frames in their track, of each value of the columns `more`."""
    return Window.partitionBy(*more, "track").orderBy("us", "id")


@query("win_lag_dt", f"WITH {FRAMES}, s AS (SELECT track, h - lag(h) OVER w AS dt FROM e {W}) SELECT track, count(*) FILTER (WHERE abs(dt - round(dt)) < 0.05) AS on_grid, count(*) FILTER (WHERE dt > 24) AS gaps, count(dt) AS n FROM s GROUP BY 1")
def win_lag_dt(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).withColumn("dt", c("h") - F.lag("h").over(in_track()))
    return s.groupBy("track").agg(F.count_if(F.abs(c("dt") - F.round("dt")) < 0.05).alias("on_grid"), F.count_if(c("dt") > 24).alias("gaps"), F.count("dt").alias("n"))


@query("win_row_number_rank", f"WITH {TURNS} SELECT play, line, player, part, CAST(row_number() OVER (PARTITION BY play ORDER BY angle DESC, line, player, part) AS INTEGER) AS rank FROM t")
def win_row_number_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("play").orderBy(F.desc("angle"), "line", "player", "part")
    return turns(spark, d).select(*K, F.row_number().over(w).alias("rank"))


@query("win_count_min_max", f"WITH {TURNS} SELECT play, line, player, part, count(*) OVER (PARTITION BY play) AS n, CASE WHEN count(*) OVER (PARTITION BY play) >= 2 THEN max(angle) OVER (PARTITION BY play) - min(angle) OVER (PARTITION BY play) END AS spread FROM t")
def win_count_min_max(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("play")
    n = F.count("*").over(w)
    return turns(spark, d).select(*K, n.alias("n"), F.when(n >= 2, F.max("angle").over(w) - F.min("angle").over(w)).alias("spread"))


@query("win_drive_sequence", f"WITH {FRAMES}, p AS (SELECT *, nullif(label, (SELECT max(label) FROM e)) AS who FROM e), f AS (SELECT track, id, us, who, CASE WHEN who IS NOT DISTINCT FROM lag(who) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM p {W}) SELECT track, id, CAST(CASE WHEN who IS NOT NULL THEN sum(new) OVER w - 1 END AS BIGINT) AS drive FROM f {W}")
def win_drive_sequence(spark: SparkSession, d: str) -> DataFrame:
    e = frames(spark, d)
    last = F.broadcast(e.agg(F.max("label").alias("last")))
    p = e.crossJoin(last).withColumn("who", F.nullif("label", c("last")))
    new = F.when(c("who").eqNullSafe(F.lag("who").over(in_track())) & (F.row_number().over(in_track()) > 1), 0).otherwise(1)
    p = p.withColumn("new", new)
    return p.select("track", "id", F.when(c("who").isNotNull(), F.sum("new").over(in_track()) - 1).alias("drive"))


@query("win_order_inversion", f"WITH {FRAMES}, s AS (SELECT track, id < lag(id) OVER w AS back FROM e WINDOW w AS (PARTITION BY track ORDER BY us, id)) SELECT track, count(*) FILTER (WHERE back) AS inversions FROM s GROUP BY 1")
def win_order_inversion(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).withColumn("back", c("id") < F.lag("id").over(in_track()))
    return s.groupBy("track").agg(F.count_if("back").alias("inversions"))


@query("win_cum_before", f"WITH {FRAMES}, v AS (SELECT track, id, us, CASE WHEN x >= 20 THEN x END AS v FROM e) SELECT track, id, round(CASE WHEN row_number() OVER w = 1 THEN 0 ELSE sum(v) OVER (PARTITION BY track ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, 4) AS load FROM v {W}")
def win_cum_before(spark: SparkSession, d: str) -> DataFrame:
    v = frames(spark, d).withColumn("v", F.when(c("x") >= 20, c("x")))
    earlier = F.sum("v").over(in_track().rowsBetween(Window.unboundedPreceding, -1))
    return v.select("track", "id", R(F.when(F.row_number().over(in_track()) == 1, 0.0).otherwise(earlier), 4).alias("load"))


@query("win_rolling_exact_n", f"WITH {FRAMES}, v AS (SELECT track, id, us, CASE WHEN x >= 5 THEN x END AS v FROM e) SELECT track, id, round(CASE WHEN count(v) OVER f = 3 THEN sum(v) OVER f END, 4) AS last3 FROM v WINDOW f AS (PARTITION BY track ORDER BY us, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def win_rolling_exact_n(spark: SparkSession, d: str) -> DataFrame:
    f = in_track().rowsBetween(-3, -1)
    v = frames(spark, d).withColumn("v", F.when(c("x") >= 5, c("x")))
    return v.select("track", "id", R(F.when(F.count("v").over(f) == 3, F.sum("v").over(f)), 4).alias("last3"))


@query("win_decayed_load", f"WITH {FRAMES}, r AS (SELECT *, h - min(h) OVER (PARTITION BY track) AS r FROM e) SELECT track, id, round(sum(x * power(2, r / 48)) OVER (PARTITION BY track ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * power(2, -r / 48), 4) AS load FROM r")
def win_decayed_load(spark: SparkSession, d: str) -> DataFrame:
    """Time is cut into blocks of ten half-lives, so that no power of two grows with a track: rows before in the
    block, and the sums of the seven blocks before (what lies further back is below the last bit)."""
    half, wide = 48.0, 480.0
    r = frames(spark, d).withColumn("r", c("h") - F.min("h").over(Window.partitionBy("track"))).withColumn("block", F.floor(c("r") / wide))
    r = r.withColumn("since", c("r") - c("block") * wide)
    grown = c("x") * F.pow(F.lit(2.0), c("since") / half)
    own = F.sum(grown).over(Window.partitionBy("track", "block").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1))
    sums = r.groupBy("track", "block").agg(F.sum(grown).alias("s"))
    back = Window.partitionBy("track").orderBy("block").rangeBetween(-7, -1)
    sums = sums.withColumn("before", F.collect_list(F.struct("block", "s")).over(back))
    carried = F.aggregate("before", F.lit(0.0), lambda a, x: a + x["s"] * F.pow(F.lit(2.0), (x["block"] - c("block")) * wide / half))
    rows = r.withColumn("own", own).join(sums.select("track", "block", carried.alias("carried"), (F.size("before") > 0).alias("any")), ["track", "block"])
    total = F.when(c("own").isNotNull() | c("any"), F.coalesce("own", F.lit(0.0)) + c("carried"))
    return rows.select("track", "id", R(total * F.pow(F.lit(2.0), -c("since") / half), 4).alias("load"))


@query("win_rest_between", f"WITH {FRAMES}, s AS (SELECT track, id, h - lag(h + x / 100) OVER w AS rest, row_number() OVER w AS n FROM e {W}) SELECT track, id, round(CASE WHEN rest >= 0 THEN rest END, 6) AS rest, n - 1 AS before FROM s")
def win_rest_between(spark: SparkSession, d: str) -> DataFrame:
    rest = c("h") - F.lag(c("h") + c("x") / 100).over(in_track())
    return frames(spark, d).select("track", "id", rest.alias("rest"), (F.row_number().over(in_track()) - 1).cast("long").alias("before")).withColumn("rest", R(F.when(c("rest") >= 0, c("rest"))))


@query("win_within_group_z", f"WITH {TURNS} SELECT play, line, player, part, round(CASE WHEN stddev_samp(price) OVER w > 0 THEN (price - avg(price) OVER w) / stddev_samp(price) OVER w ELSE 0 END, 6) AS z FROM t WINDOW w AS (PARTITION BY player)")
def win_within_group_z(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("player")
    sd = F.stddev_samp("price").over(w)
    return turns(spark, d).select(*K, R(F.when(sd > 0, (c("price") - F.avg("price").over(w)) / sd).otherwise(0.0)).alias("z"))


@query("win_demean", f"WITH {TURNS} SELECT play, line, player, part, round(price - avg(price) OVER (PARTITION BY player), 4) AS rest FROM t")
def win_demean(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select(*K, R(c("price") - F.avg("price").over(Window.partitionBy("player")), 4).alias("rest"))


@query("win_ntile_bins", f"WITH {TURNS} SELECT play, line, player, part, CASE WHEN count(*) OVER (PARTITION BY player) < 8 THEN 1 ELSE CAST(ntile(4) OVER (PARTITION BY player ORDER BY price, play, line, part) AS INTEGER) END AS bin FROM t")
def win_ntile_bins(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("player"))  # too few rows for four bins are one
    return turns(spark, d).select(*K, F.when(n < 8, 1).otherwise(F.ntile(4).over(Window.partitionBy("player").orderBy("price", "play", "line", "part"))).alias("bin"))


HALF = "half AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY shipped, play, line, part) % 2 AS odd FROM t)"


def halves(t: DataFrame) -> DataFrame:
    return t.withColumn("odd", F.row_number().over(Window.partitionBy("player").orderBy("shipped", "play", "line", "part")) % 2)


@query("win_alternate_halves", f"WITH {TURNS}, {HALF} SELECT player, odd::BIGINT AS odd, count(*) AS n, round(avg(price), 4) AS mean FROM half GROUP BY 1, 2")
def win_alternate_halves(spark: SparkSession, d: str) -> DataFrame:
    return halves(turns(spark, d)).groupBy("player", c("odd").cast("long").alias("odd")).agg(F.count("*").alias("n"), R(F.avg("price"), 4).alias("mean"))


@query("win_rolling_median", f"WITH {FRAMES} SELECT track, id, round(quantile_cont(x, 0.5) OVER (PARTITION BY track ORDER BY us, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM e")
def win_rolling_median(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("track", "id", R(F.percentile("x", 0.5).over(in_track().rowsBetween(-2, 2))).alias("smooth"))


@query("win_dedupe_first", f"WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY play, line ORDER BY player, part) AS n, count(*) OVER (PARTITION BY play, line) - 1 AS dropped FROM t) SELECT play, line, player, part, dropped FROM r WHERE n = 1")
def win_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("play", "line")
    r = turns(spark, d).withColumn("n", F.row_number().over(w.orderBy("player", "part"))).withColumn("dropped", F.count("*").over(w) - 1)
    return r.where("n = 1").select(*K, "dropped")


@query("win_rank_min_ties", f"WITH {TURNS}, p AS (SELECT grp, player, count(*) FILTER (WHERE angle >= 45) AS n FROM t GROUP BY 1, 2) SELECT grp, player, n, CAST(rank() OVER (PARTITION BY grp ORDER BY n DESC) AS INTEGER) AS rank FROM p")
def win_rank_min_ties(spark: SparkSession, d: str) -> DataFrame:
    p = turns(spark, d).groupBy("grp", "player").agg(F.count_if(c("angle") >= 45).alias("n"))
    counts = p.groupBy("grp", "n").agg(F.count("*").alias("m"))  # as many rows as there are different counts
    above = Window.partitionBy("grp").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("grp", "n", (F.coalesce(F.sum("m").over(above), F.lit(0)) + 1).cast("int").alias("rank"))
    return p.join(ranks, ["grp", "n"]).select("grp", "player", "n", "rank")


@query("win_running_id_runs", f"WITH {FRAMES}, f AS (SELECT track, us, id, min(CASE WHEN x >= 30 THEN 1 ELSE 0 END) OVER q AS ok, count(*) OVER q AS n FROM e WINDOW q AS (PARTITION BY track ORDER BY us, id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT track, min(us) AS first_us FROM f WHERE ok = 1 AND n = 3 GROUP BY 1")
def win_running_id_runs(spark: SparkSession, d: str) -> DataFrame:
    q = in_track().rowsBetween(0, 2)
    f = frames(spark, d).withColumn("ok", F.min((c("x") >= 30).cast("int")).over(q)).withColumn("n", F.count("*").over(q))
    return f.where("ok = 1 and n = 3").groupBy("track").agg(F.min("us").alias("first_us"))


@query("topk_with_ties", f"WITH {TURNS} SELECT player, play, line, part, angle FROM t QUALIFY rank() OVER (PARTITION BY player ORDER BY angle DESC) <= 3")
def topk_with_ties(spark: SparkSession, d: str) -> DataFrame:
    r = turns(spark, d).withColumn("r", F.rank().over(Window.partitionBy("player").orderBy(F.desc("angle"))))
    return r.where("r <= 3").select("player", "play", "line", "part", "angle")


@query("topk_strict", f"WITH {TURNS}, g AS (SELECT player, CAST(floor(angle / 10) AS BIGINT) AS cell, round(sum(price), 2) AS weight, round(avg(value), 6) AS share FROM t GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY player ORDER BY weight DESC, share, cell) <= 2")
def topk_strict(spark: SparkSession, d: str) -> DataFrame:
    g = cells(turns(spark, d)).groupBy("player", "cell").agg(R(F.sum("price"), 2).alias("weight"), R(F.avg("value")).alias("share"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("player").orderBy(F.desc("weight"), "share", "cell"))).where("r <= 2").drop("r")


@query("topk_mean", f"WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY price DESC, play, line, part) AS r, count(*) OVER (PARTITION BY player) AS n FROM t) SELECT player, round(avg(price) FILTER (WHERE r <= 5), 4) AS top5, round(avg(price) FILTER (WHERE r <= ceil(n / 2.0)), 4) AS top_half, round(quantile_cont(price, 0.9), 4) AS q90 FROM r GROUP BY 1")
def topk_mean(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("player")
    r = turns(spark, d).withColumn("r", F.row_number().over(w.orderBy(F.desc("price"), "play", "line", "part"))).withColumn("n", F.count("*").over(w))
    return r.groupBy("player").agg(R(F.avg(F.when(c("r") <= 5, c("price"))), 4).alias("top5"), R(F.avg(F.when(c("r") <= F.ceil(c("n") / 2), c("price"))), 4).alias("top_half"), R(F.percentile("price", 0.9), 4).alias("q90"))


@query("bottomk_excluding", f"WITH {TURNS} SELECT player, play, line, part, price FROM t WHERE player NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) QUALIFY row_number() OVER (PARTITION BY player ORDER BY price, play, line, part) <= 2")
def bottomk_excluding(spark: SparkSession, d: str) -> DataFrame:
    bad = read(spark, d, "supplier").where("s_acctbal < 0").select(c("s_suppkey").alias("player"))
    r = turns(spark, d).join(bad, "player", "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("player").orderBy("price", "play", "line", "part")))
    return r.where("r <= 2").select("player", "play", "line", "part", "price")


@query("median_pick", f"WITH {TURNS} SELECT player, play, line, part, price FROM t QUALIFY row_number() OVER (PARTITION BY player ORDER BY price, play, line, part) = floor(count(*) OVER (PARTITION BY player) / 2) + 1")
def median_pick(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("player")
    r = turns(spark, d).withColumn("r", F.row_number().over(w.orderBy("price", "play", "line", "part"))).withColumn("n", F.count("*").over(w))
    return r.where("r = floor(n / 2) + 1").select("player", "play", "line", "part", "price")


@query("stable_total_order", f"WITH {TURNS} SELECT play, line, player, part, angle FROM t ORDER BY angle DESC, play, line, player, part")
def stable_total_order(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select(*K, "angle").orderBy(F.desc("angle"), *K)


