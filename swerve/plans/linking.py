"""Queries of section 2.11: linkage and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swerve.functions import columns as X
from swerve.operators import links as L
from swerve.sources.tables import TURNS, read, turns

from .aggregating import R
from .joining import TEAM, with_team
from .registry import query

c = F.col
K = ["play", "line", "player", "part"]
# events: sharp turns; candidates: other players of another team in the play whose tax is high
CAND = f"{TURNS}, {TEAM}, ev AS (SELECT * FROM p WHERE angle >= 40), j AS (SELECT a.play, a.line, a.player, a.part, b.player AS other, b.price AS outcome, abs(a.angle - b.angle) AS dist, a.value FROM ev a JOIN p b ON a.play = b.play AND a.player <> b.player AND a.team <> b.team WHERE b.tax >= 0.05), n AS (SELECT e.play, e.line, e.player, e.part, count(j.other) AS n FROM ev e LEFT JOIN j USING (play, line, player, part) GROUP BY 1, 2, 3, 4)"


def candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = with_team(spark, d)
    ev = p.where("angle >= 40")
    b = p.where("tax >= 0.05").select("play", c("player").alias("other"), c("team").alias("ot"), c("price").alias("outcome"), c("angle").alias("oa"))
    j = ev.join(b, "play").where("player != other and team != ot").withColumn("dist", F.abs(c("angle") - c("oa")))
    return ev, j.select(*K, "other", "outcome", "dist", "value")


def counted(spark: SparkSession, d: str) -> DataFrame:
    ev, j = candidates(spark, d)
    n = j.groupBy(*K).agg(F.count("*").alias("n"))
    return ev.select(*K).join(n, K, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("link_candidates", f"WITH {CAND} SELECT play, line, player, part, n, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'multiple' END AS status FROM n")
def link_candidates(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d).select(*K, "n", L.status(c("n")).alias("status"))


@query("link_single_candidate", f"WITH {CAND} SELECT j.play, j.line, j.player, j.part, other, outcome FROM j JOIN n USING (play, line, player, part) WHERE n = 1")
def link_single_candidate(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d)[1].join(counted(spark, d).where("n = 1"), K).select(*K, "other", "outcome")


@query("link_all_candidates", f"WITH {CAND} SELECT j.play, j.line, j.player, j.part, other, outcome FROM j JOIN n USING (play, line, player, part) WHERE n >= 2")
def link_all_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d)[1].join(counted(spark, d).where("n >= 2"), K).select(*K, "other", "outcome")


@query("link_radius_match", f"WITH {CAND}, r AS (SELECT play, line, player, part, count(*) FILTER (WHERE dist <= 5) AS in5, count(*) FILTER (WHERE dist <= 15) AS in15, arg_min(other, (dist, other)) AS nearest, list_sort(list(dist))[2] - min(dist) AS margin FROM j GROUP BY 1, 2, 3, 4) SELECT *, CASE WHEN in5 = 1 THEN 'unique' WHEN in5 > 1 THEN 'multiple' WHEN in15 > 0 THEN 'wide' ELSE 'none' END AS status FROM r")
def link_radius_match(spark: SparkSession, d: str) -> DataFrame:
    r = candidates(spark, d)[1].groupBy(*K).agg(F.count_if(c("dist") <= 5).alias("in5"), F.count_if(c("dist") <= 15).alias("in15"), F.min_by("other", F.struct("dist", "other")).alias("nearest"), (F.get(F.array_sort(F.collect_list("dist")), 1) - F.min("dist")).alias("margin"))
    return r.withColumn("status", F.when(c("in5") == 1, "unique").when(c("in5") > 1, "multiple").when(c("in15") > 0, "wide").otherwise("none"))


@query("link_persistence", f"WITH {CAND}, r AS (SELECT play, line, player, part, arg_min(other, (dist, other)) AS first, arg_min(other, (outcome, other)) AS later FROM j GROUP BY 1, 2, 3, 4) SELECT count(*) AS n, count(*) FILTER (WHERE first = later) AS same FROM r")
def link_persistence(spark: SparkSession, d: str) -> DataFrame:
    r = candidates(spark, d)[1].groupBy(*K).agg(F.min_by("other", F.struct("dist", "other")).alias("first"), F.min_by("other", F.struct("outcome", "other")).alias("later"))
    return r.agg(F.count("*").alias("n"), F.count_if(c("first") == c("later")).alias("same"))


RULES = "r AS (SELECT play, line, player, part, CASE WHEN count(*) FILTER (WHERE dist <= 3) = 1 THEN min(other) FILTER (WHERE dist <= 3) END AS a, CASE WHEN count(*) FILTER (WHERE outcome > 60000) = 1 THEN min(other) FILTER (WHERE outcome > 60000) END AS b, CASE WHEN count(*) = 1 THEN min(other) END AS c FROM j GROUP BY 1, 2, 3, 4)"


def ruled(spark: SparkSession, d: str) -> DataFrame:
    only = lambda rule: F.when(F.count_if(rule) == 1, F.min(F.when(rule, c("other"))))
    return candidates(spark, d)[1].groupBy(*K).agg(only(c("dist") <= 3).alias("a"), only(c("outcome") > 60000).alias("b"), only(F.lit(True)).alias("c"))


@query("link_rule_cascade", f"WITH {CAND}, {RULES} SELECT play, line, player, part, coalesce(a, b, c) AS linked, CASE WHEN a IS NOT NULL THEN 'near' WHEN b IS NOT NULL THEN 'outcome' WHEN c IS NOT NULL THEN 'only' ELSE 'missed' END AS rule FROM r")
def link_rule_cascade(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d).select(*K, F.coalesce("a", "b", "c").alias("linked"), X.first_rule([(c("a").isNotNull(), "near"), (c("b").isNotNull(), "outcome"), (c("c").isNotNull(), "only")], "missed").alias("rule"))


@query("link_slot_precedence", f"WITH {CAND}, f AS (SELECT DISTINCT play, line, player, part, 'five' AS slot FROM j WHERE dist <= 5), g AS (SELECT DISTINCT play, line, player, part, 'eight' AS slot FROM j WHERE dist <= 8 AND (play, line, player, part) NOT IN (SELECT (play, line, player, part) FROM f)), h AS (SELECT DISTINCT play, line, player, part, 'rule' AS slot FROM j WHERE outcome > 60000 AND (play, line, player, part) NOT IN (SELECT (play, line, player, part) FROM f UNION ALL SELECT (play, line, player, part) FROM g)) SELECT * FROM f UNION ALL SELECT * FROM g UNION ALL SELECT * FROM h")
def link_slot_precedence(spark: SparkSession, d: str) -> DataFrame:
    j = candidates(spark, d)[1]
    return L.slots(j, K, [("five", c("dist") <= 5), ("eight", c("dist") <= 8), ("rule", c("outcome") > 60000)]).select(*K, "slot").distinct()


@query("link_funnel", f"WITH {CAND} SELECT unnest(['events', 'linked', 'single']) AS step, unnest([count(*), count(*) FILTER (WHERE n > 0), count(*) FILTER (WHERE n = 1)]) AS n, unnest([0, count(*) FILTER (WHERE n = 0), count(*) FILTER (WHERE n > 1)]) AS lost FROM n")
def link_funnel(spark: SparkSession, d: str) -> DataFrame:
    n = counted(spark, d).agg(F.count("*").alias("e"), F.count_if(c("n") > 0).alias("l"), F.count_if(c("n") == 1).alias("s"))
    return n.selectExpr("stack(3, 'events', e, 0L, 'linked', l, e - l, 'single', s, l - s) AS (step, n, lost)")


@query("link_composition", f"WITH {CAND}, m AS (SELECT n.n = 1 AS single, t.grp AS level, t.angle FROM n JOIN t USING (play, line, player, part)), a AS (SELECT level, count(*) FILTER (WHERE single) AS n1, count(*) FILTER (WHERE NOT single) AS n2, round(avg(angle) FILTER (WHERE single), 4) AS mean1, round(avg(angle) FILTER (WHERE NOT single), 4) AS mean2 FROM m GROUP BY 1) SELECT level, n1, n2, mean1, mean2, round(n1 / (sum(n1) OVER ())::DOUBLE - n2 / (sum(n2) OVER ())::DOUBLE, 9) AS share_difference FROM a")
def link_composition(spark: SparkSession, d: str) -> DataFrame:
    m = counted(spark, d).join(turns(spark, d).select(*K, "grp", "angle"), K).withColumn("single", c("n") == 1)
    a = m.groupBy(c("grp").alias("level")).agg(F.count_if("single").alias("n1"), F.count_if(~c("single")).alias("n2"), R(F.avg(F.when(c("single"), c("angle"))), 4).alias("mean1"), R(F.avg(F.when(~c("single"), c("angle"))), 4).alias("mean2"))
    whole = F.broadcast(a.agg(F.sum("n1").alias("s1"), F.sum("n2").alias("s2")))
    return a.crossJoin(whole).select("level", "n1", "n2", "mean1", "mean2", R(c("n1") / c("s1") - c("n2") / c("s2"), 9).alias("share_difference"))


@query("link_fuzzy_one_to_one")
def link_fuzzy_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_one_to_one(read(spark, d, "part"))


def fuzzy_one_to_one(part: DataFrame, least: float = 0.6) -> DataFrame:
    """Even keys matched to odd ones of the same p_size, by 0.7 name and 0.3 brand similarity of `least` or more."""
    bound = (least - 5e-7 - 0.3) / 0.7  # what the name must reach where the brands are equal and the score is rounded up
    p = part.where("p_size is not null and p_partkey is not null and p_name is not null and p_brand is not null")
    items = p.select("p_size", F.when(F.pmod("p_partkey", F.lit(2)) == 0, "l").otherwise("r").alias("side"), "p_name", "p_brand", F.to_json(F.struct("p_name", "p_brand")).alias("kind"), c("p_partkey").alias("id"))
    kinds = items.drop("id").distinct()
    names = kinds.select("p_size", "side", "p_name").distinct().withColumn("token", F.explode(L.name_tokens(c("p_name"), bound)))
    a = names.where("side = 'l'").select("p_size", "token", c("p_name").alias("ln"))
    b = names.where("side = 'r'").select("p_size", "token", c("p_name").alias("rn"))
    near = a.join(b, ["p_size", "token"]).select("p_size", "ln", "rn").distinct().withColumn("s", X.similarity(c("ln"), c("rn"))).where(c("s") >= bound - 1e-9)
    la = kinds.where("side = 'l'").select("p_size", c("p_name").alias("ln"), c("p_brand").alias("lb"), c("kind").alias("lk"))
    ra = kinds.where("side = 'r'").select("p_size", c("p_name").alias("rn"), c("p_brand").alias("rb"), c("kind").alias("rk"))
    pairs = near.join(la, ["p_size", "ln"]).join(ra, ["p_size", "rn"]).withColumn("score", R(0.7 * c("s") + 0.3 * X.similarity(c("lb"), c("rb")))).where(c("score") >= least)
    return L.one_to_one_of_kinds(items, pairs, "p_size")


@query("link_name_resolve", "WITH k AS (SELECT p_partkey, substr(p_name, 1, 1) AS initial, string_split(p_name, ' ')[-1] AS surname, p_size FROM part), u AS (SELECT initial, surname, p_size, min(p_partkey) AS id FROM k GROUP BY 1, 2, 3 HAVING count(*) = 1) SELECT p_partkey, id FROM k JOIN u USING (initial, surname, p_size)")
def link_name_resolve(spark: SparkSession, d: str) -> DataFrame:
    keys = ["initial", "surname", "p_size"]
    k = read(spark, d, "part").select("p_partkey", F.substring("p_name", 1, 1).alias("initial"), F.element_at(F.split("p_name", " "), -1).alias("surname"), "p_size")
    u = k.groupBy(*keys).agg(F.count("*").alias("n"), F.min("p_partkey").alias("id")).where("n = 1")
    return k.join(u, keys).select("p_partkey", "id")


@query("link_engagement", f"WITH {CAND}, b AS (SELECT player, other, count(*) AS n FROM j GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY player ORDER BY n DESC) AS r, n / (sum(n) OVER (PARTITION BY player))::DOUBLE AS share FROM b), f AS (SELECT player, count(*) AS tied, min(other) AS other, max(share) AS share FROM r WHERE r = 1 GROUP BY 1) SELECT player, CASE WHEN tied = 1 AND share >= 0.02 THEN other END AS engaged, CASE WHEN tied > 1 THEN 'tied' WHEN share < 0.02 THEN 'low' ELSE 'engaged' END AS status FROM f")
def link_engagement(spark: SparkSession, d: str) -> DataFrame:
    b = candidates(spark, d)[1].groupBy("player", "other").agg(F.count("*").alias("n"))
    w = Window.partitionBy("player")
    f = b.withColumn("r", F.rank().over(w.orderBy(F.desc("n")))).withColumn("share", c("n") / F.sum("n").over(w)).where("r = 1").groupBy("player").agg(F.count("*").alias("tied"), F.min("other").alias("other"), F.max("share").alias("share"))
    return f.select("player", F.when((c("tied") == 1) & (c("share") >= 0.02), c("other")).alias("engaged"), F.when(c("tied") > 1, "tied").when(c("share") < 0.02, "low").otherwise("engaged").alias("status"))


@query("link_exact_match_pairs")
def link_exact_match_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).withColumn("stratum", F.floor(c("angle") / 10)).withColumn("high", c("value") >= 0.05)
    w = Window.partitionBy("player", "stratum", "high").orderBy(F.xxhash64(F.lit(3), *K), *K)
    t = t.withColumn("n", F.row_number().over(w))
    a = t.where("high").select("player", "stratum", "n", c("play").alias("play_high"), c("price").alias("price_high"))
    b = t.where("not high").select("player", "stratum", "n", c("play").alias("play_low"), c("price").alias("price_low"))
    return a.join(b, ["player", "stratum", "n"]).withColumn("difference", R(c("price_high") - c("price_low"), 4))


@query("link_snapshot_trend", "WITH s AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS a, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') AS b FROM orders GROUP BY 1) SELECT o_custkey, round(b - a, 4) AS trend FROM s")
def link_snapshot_trend(spark: SparkSession, d: str) -> DataFrame:
    last = lambda day: F.max_by("o_totalprice", F.when(c("o_orderdate").cast("timestamp_ntz") < F.expr(f"timestamp_ntz'{day} 00:00:00'"), F.struct("o_orderdate", "o_orderkey")))
    s = read(spark, d, "orders").groupBy("o_custkey").agg(last("1996-01-01").alias("a"), last("1997-01-01").alias("b"))
    return s.select("o_custkey", R(c("b") - c("a"), 4).alias("trend"))


@query("link_groups_by_threshold", f"WITH {TURNS} SELECT player, CASE WHEN list_contains(list(DISTINCT grp), 'A') AND count(*) >= 600 THEN 'core' WHEN list_contains(list(DISTINCT grp), 'R') THEN 'mixed' ELSE 'rest' END AS kind FROM t GROUP BY 1")
def link_groups_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    p = turns(spark, d).groupBy("player").agg(F.collect_set("grp").alias("g"), F.count("*").alias("n"))
    return p.select("player", X.first_rule([(F.array_contains("g", "A") & (c("n") >= 600), "core"), (F.array_contains("g", "R"), "mixed")], "rest").alias("kind"))
