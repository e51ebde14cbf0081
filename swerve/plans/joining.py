"""Queries of sections 2.3 and 2.7: joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swerve.operators import joins as J
from swerve.sources.tables import FRAMES, TURNS, frames, read, turns

from .registry import query

K = ["play", "line", "player", "part"]
c = F.col


@query("join_inner_multi_key", f"WITH {TURNS} SELECT a.play, a.line, a.player, a.part, count(*) AS n FROM t a JOIN t b ON a.play = b.play AND a.player = b.player GROUP BY 1, 2, 3, 4")
def join_inner_multi_key(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    return t.select(*K).join(t.select("play", "player"), ["play", "player"]).groupBy(*K).agg(F.count("*").alias("n"))


@query("join_left_context", f"WITH {TURNS} SELECT play, line, player, part, o_orderpriority AS context, o_orderkey IS NOT NULL AS present FROM t LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON play = o_orderkey")
def join_left_context(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderstatus = 'F'")
    return turns(spark, d).join(o, c("play") == c("o_orderkey"), "left").select(*K, c("o_orderpriority").alias("context"), c("o_orderkey").isNotNull().alias("present"))


@query("join_left_guarded", f"WITH {TURNS} SELECT play, line, player, part, s_name AS name FROM t LEFT JOIN supplier ON player = s_suppkey")
def join_left_guarded(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select(c("s_suppkey").alias("player"), c("s_name").alias("name"))
    return J.left_guarded(turns(spark, d).select(*K), s, ["player"]).select(*K, "name")


TEAM = "p AS (SELECT t.*, s_nationkey AS team FROM t JOIN supplier ON player = s_suppkey)"


def with_team(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select(c("s_suppkey").alias("player"), c("s_nationkey").alias("team"))
    return turns(spark, d).join(s, "player")


@query("join_self_opponents", f"WITH {TURNS}, {TEAM} SELECT a.play, a.line, a.player, a.part, count(*) AS opponents FROM p a JOIN p b ON a.play = b.play AND a.player <> b.player AND a.team <> b.team GROUP BY 1, 2, 3, 4")
def join_self_opponents(spark: SparkSession, d: str) -> DataFrame:
    p = with_team(spark, d)
    b = p.select("play", c("player").alias("other"), c("team").alias("other_team"))
    return p.join(b, "play").where("player != other and team != other_team").groupBy(*K).agg(F.count("*").alias("opponents"))


@query("join_time_tolerance", f"WITH {FRAMES} SELECT a.track, a.id, b.id AS near FROM e a JOIN e b ON a.track = b.track AND a.id <> b.id AND abs(a.us - b.us) <= 3600000000")
def join_time_tolerance(spark: SparkSession, d: str) -> DataFrame:
    e = frames(spark, d)
    return J.within_time(e.select("track", "id", "us"), e.select("track", c("id").alias("near"), c("us").alias("near_us")), ["track"], "us", "near_us", 3_600_000_000).where("id != near").select("track", "id", "near")


@query("join_time_window", f"WITH {FRAMES}, s AS (SELECT *, us - min(us) OVER (PARTITION BY track) AS r FROM e) SELECT a.track, a.id, count(*) AS n FROM s a JOIN s b ON a.track = b.track AND b.r BETWEEN a.r - 60000000 AND a.r + 7200000000 GROUP BY 1, 2")
def join_time_window(spark: SparkSession, d: str) -> DataFrame:
    r = c("us") - F.min("us").over(Window.partitionBy("track"))
    s = frames(spark, d).select("track", "id", r.alias("r"))
    b = s.select("track", c("r").alias("other"))
    return J.within_time(s, b, ["track"], "r", "other", 7_200_000_000).where(c("other").between(c("r") - 60_000_000, c("r") + 7_200_000_000)).groupBy("track", "id").agg(F.count("*").alias("n"))


@query("join_nearest_point", f"WITH {FRAMES}, j AS (SELECT a.track, a.id, b.id AS near, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS distance, row_number() OVER (PARTITION BY a.track, a.id ORDER BY round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6), b.id) AS n FROM e a JOIN e b ON a.track = b.track AND a.id <> b.id) SELECT track, id, near, distance FROM j WHERE n = 1 AND distance <= 2.5")
def join_nearest_point(spark: SparkSession, d: str) -> DataFrame:
    e = frames(spark, d)
    b = e.select("track", c("id").alias("near"), c("x").alias("bx"), c("y").alias("by"))
    return J.nearest(J.within_cells(e, b, ["track"], ("x", "y"), ("bx", "by"), 2.5).where("id != near"), ["track", "id"], F.round(F.sqrt(F.pow(c("x") - c("bx"), 2) + F.pow(c("y") - c("by"), 2)), 6), ["near"], 2.5).select("track", "id", "near", "distance")


@query("join_nearest_other", f"WITH {TURNS}, {TEAM}, j AS (SELECT a.play, a.line, a.player, a.part, b.player AS other, abs(a.angle - b.angle) AS dist FROM p a JOIN p b ON a.play = b.play AND a.team <> b.team) SELECT play, line, player, part, arg_min(other, (dist, other)) AS nearest, count(*) FILTER (WHERE dist <= 10) AS near FROM j GROUP BY 1, 2, 3, 4")
def join_nearest_other(spark: SparkSession, d: str) -> DataFrame:
    p = with_team(spark, d)
    b = p.select("play", c("player").alias("other"), c("team").alias("bt"), c("angle").alias("ba"))
    j = p.join(b, "play").where("team != bt").withColumn("dist", F.abs(c("angle") - c("ba")))
    return j.groupBy(*K).agg(F.min_by("other", F.struct("dist", "other")).alias("nearest"), F.count_if(c("dist") <= 10).alias("near"))


@query("join_nearest_in_time", f"WITH {FRAMES}, r AS (SELECT track, id, h - min(h) OVER (PARTITION BY track) - 100 AS r FROM e) SELECT track, coalesce(arg_min(id, (abs(r), r, id)) FILTER (WHERE abs(r) <= 2), arg_max(id, (r, id)) FILTER (WHERE r < 0)) AS id FROM r GROUP BY 1")
def join_nearest_in_time(spark: SparkSession, d: str) -> DataFrame:
    r = c("h") - F.min("h").over(Window.partitionBy("track")) - 100
    e = frames(spark, d).withColumn("r", r)
    near = F.min_by("id", F.when(F.abs(c("r")) <= 2, F.struct(F.abs(c("r")).alias("a"), "r", "id")))
    last = F.max_by("id", F.when(c("r") < 0, F.struct("r", "id")))
    return e.groupBy("track").agg(F.coalesce(near, last).alias("id"))


@query("join_semi_keys", f"WITH {TURNS} SELECT play, line, player, part FROM t WHERE player IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def join_semi_keys(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").where("s_acctbal > 5000").select(c("s_suppkey").alias("player"))
    return turns(spark, d).join(s, "player", "left_semi").select(*K)


@query("join_anti_taken", f"WITH {TURNS} SELECT play, line, player, part FROM t WHERE play NOT IN (SELECT play FROM t WHERE angle >= 45)")
def join_anti_taken(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    return t.join(t.where("angle >= 45").select("play"), "play", "left_anti").select(*K)


@query("join_full_outer_counts", f"WITH {TURNS}, a AS (SELECT player, part, count(*) AS n FROM t WHERE setting = 'F' GROUP BY 1, 2), b AS (SELECT player, part, count(*) AS n FROM t WHERE setting = 'O' GROUP BY 1, 2) SELECT coalesce(a.player, b.player) AS player, coalesce(a.part, b.part) AS part, coalesce(a.n, 0) AS n_f, coalesce(b.n, 0) AS n_o FROM a FULL JOIN b ON a.player = b.player AND a.part = b.part")
def join_full_outer_counts(spark: SparkSession, d: str) -> DataFrame:
    t, key = turns(spark, d), ["player", "part"]
    side = lambda s, n: t.where(c("setting") == s).groupBy(*key).agg(F.count("*").alias(n))
    zero = F.lit(0).cast("long")
    return side("F", "n_f").join(side("O", "n_o"), key, "full").select(*key, F.coalesce("n_f", zero).alias("n_f"), F.coalesce("n_o", zero).alias("n_o"))


@query("join_cross_grid", "SELECT s_suppkey AS player, i.i * 3 + j.j AS cell FROM supplier, (SELECT unnest([0, 1]) AS i) i, (SELECT unnest([0, 1, 2]) AS j) j")
def join_cross_grid(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array(*[F.lit(i * 3 + j) for i in range(2) for j in range(3)])  # a fixed grid: no join is needed
    return read(spark, d, "supplier").select(c("s_suppkey").alias("player"), F.explode(cells).alias("cell"))


@query("join_play_event", f"WITH {FRAMES}, s AS (SELECT track, min(us) AS snap FROM e WHERE label = (SELECT min(label) FROM e) GROUP BY 1) SELECT e.track, e.id, us - snap AS since FROM e JOIN s ON e.track = s.track")
def join_play_event(spark: SparkSession, d: str) -> DataFrame:
    e = frames(spark, d)
    label = e.agg(F.min("label").alias("first_label"))
    snap = e.join(F.broadcast(label), e.label == c("first_label"), "left_semi").groupBy("track").agg(F.min("us").alias("snap"))
    return e.join(snap, "track").select("track", "id", (c("us") - c("snap")).alias("since"))


@query("join_scalar_subquery", f"WITH {TURNS} SELECT grp, round(count(*) / (SELECT count(*) FROM t)::DOUBLE, 9) AS share FROM t GROUP BY 1")
def join_scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    return t.groupBy("grp").agg(F.count("*").alias("n")).crossJoin(F.broadcast(t.agg(F.count("*").alias("total")))).select("grp", F.round(c("n") / c("total"), 9).alias("share"))


@query("set_union_all_scopes", f"WITH {TURNS} SELECT 'all' AS scope, count(*) AS n FROM t UNION ALL SELECT 'sharp', count(*) FROM t WHERE angle >= 30 UNION ALL SELECT 'taxed', count(*) FROM t WHERE tax > 0.05")
def set_union_all_scopes(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("scope"), "n")
    return one("all", t).unionByName(one("sharp", t.where("angle >= 30"))).unionByName(one("taxed", t.where("tax > 0.05")))


@query("set_multiset_diff", f"WITH {TURNS}, a AS (SELECT play, player, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT play, player, count(*) AS n FROM t WHERE angle < 50 GROUP BY 1, 2) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    a, b = (x.groupBy("play", "player").agg(F.count("*").alias("n")) for x in (t, t.where("angle < 50")))
    return a.exceptAll(b).unionAll(b.exceptAll(a))


@query("set_symmetric_players", f"WITH {TURNS}, a AS (SELECT DISTINCT player, part FROM t WHERE setting = 'F'), b AS (SELECT DISTINCT player, part FROM t WHERE setting = 'O') (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_symmetric_players(spark: SparkSession, d: str) -> DataFrame:
    """Players with a part in one setting only, over all rows."""
    return one_sided(turns(spark, d), ["player", "part"], c("setting") == "F", c("setting") == "O")


#: Rows that a task of one_sided aggregates.
TASK_ROWS = 250_000


def one_sided(df: DataFrame, keys: list[str], left: Column, right: Column) -> DataFrame:
    """Distinct keys (null ones too) of the rows on one side that no row of the other side has. One aggregation, after
    the rows are dealt to as many tasks as keep a task's groups few."""
    rows = df.select(*keys, left.alias("_l"), right.alias("_r")).where("_l or _r")
    tasks = rows.count() // TASK_ROWS + 1
    sides = rows.repartition(tasks, *keys).groupBy(*keys).agg(F.bool_or("_l").alias("_l"), F.bool_or("_r").alias("_r"))
    return sides.where("coalesce(_l, false) <> coalesce(_r, false)").select(*keys)


@query("set_overlap_counts", f"WITH {TURNS}, u AS (SELECT DISTINCT 'a' AS slot, play, player FROM t WHERE angle >= 40 UNION SELECT DISTINCT 'b', play, player FROM t WHERE value > 0.08) SELECT n AS slots, count(*) AS keys FROM (SELECT play, player, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1")
def set_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    u = t.where("angle >= 40").select(F.lit("a").alias("slot"), "play", "player").union(t.where("value > 0.08").select(F.lit("b"), "play", "player")).distinct()
    return u.groupBy("play", "player").agg(F.count("*").alias("slots")).groupBy("slots").agg(F.count("*").alias("keys"))


@query("set_distinct_keys", f"WITH {TURNS} SELECT DISTINCT play, player FROM t")
def set_distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("play", "player").distinct()
