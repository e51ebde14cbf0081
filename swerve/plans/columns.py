"""Queries of sections 2.2 and 2.8: projections, filters, derived columns, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swerve.functions import columns as X
from swerve.sources.tables import TURNS, read, turns

from .registry import query

K = ["play", "line", "player", "part"]
EDGES = [5.0, 15.0, 30.0, 45.0]


@query("band_filter", f"WITH {TURNS} SELECT play, line, player, part, angle FROM t WHERE setting = 'F' AND grp = 'A' AND angle >= 15 AND angle < 30")
def band_filter(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    return t.where((t.setting == "F") & (t.grp == "A") & X.between(t.angle, 15, 30)).select(*K, "angle")


@query("ordered_rule_case", f"WITH {TURNS} SELECT play, line, player, part, CASE WHEN nullif(angle, 13) IS NULL THEN 'MISSING' WHEN tax > 0.06 THEN 'TAXED' WHEN grp <> 'N' THEN 'MOVED' ELSE 'OTHER' END AS label FROM t")
def ordered_rule_case(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    rules = [(F.nullif(t.angle, F.lit(13)).isNull(), "MISSING"), (t.tax > 0.06, "TAXED"), (t.grp != "N", "MOVED")]
    return t.select(*K, X.first_rule(rules, "OTHER").alias("label"))


@query("lookup_family", "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'WHEELS' WHEN 'MACHINERY' THEN 'WHEELS' WHEN 'BUILDING' THEN 'HOME' WHEN 'FURNITURE' THEN 'HOME' ELSE 'OTHER' END AS family FROM customer")
def lookup_family(spark: SparkSession, d: str) -> DataFrame:
    m = {"AUTOMOBILE": "WHEELS", "MACHINERY": "WHEELS", "BUILDING": "HOME", "FURNITURE": "HOME"}
    table = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return read(spark, d, "customer").select("c_custkey", F.coalesce(table[F.col("c_mktsegment")], F.lit("OTHER")).alias("family"))


BAND_SQL = "CASE WHEN angle >= 45 THEN '45+' WHEN angle >= 30 THEN '30-45' WHEN angle >= 15 THEN '15-30' WHEN angle >= 5 THEN '5-15' END"


@query("binned_label", f"WITH {TURNS} SELECT play, line, player, part, {BAND_SQL} AS band FROM t")
def binned_label(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    return t.select(*K, X.band(t.angle, EDGES).alias("band"))


@query("grid_cell_index", f"""WITH {TURNS}, i AS (SELECT *, CASE WHEN angle < 5 OR angle >= 45 THEN -1 WHEN angle < 15 THEN 0 WHEN angle < 30 THEN 1 ELSE 2 END AS i,
 CASE WHEN value < 0.02 OR value >= 0.08 THEN -1 WHEN value < 0.05 THEN 0 ELSE 1 END AS j FROM t)
 SELECT play, line, player, part, CAST(CASE WHEN i < 0 OR j < 0 THEN -1 ELSE i * 2 + j END AS INTEGER) AS cell FROM i""")
def grid_cell_index(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    i, j = X.axis_index(t.angle, EDGES), X.axis_index(t.value, [0.02, 0.05, 0.08])
    return t.select(*K, F.when((i < 0) | (j < 0), -1).otherwise(i * 2 + j).cast("int").alias("cell"))


@query("first_failing_reason", f"WITH {TURNS} SELECT coalesce(CASE WHEN nullif(angle, 7) IS NULL THEN 'no_angle' END, CASE WHEN value > 0.08 THEN 'value' END, CASE WHEN tax < 0.02 THEN 'tax' END, 'kept') AS reason, count(*) AS n FROM t GROUP BY 1")
def first_failing_reason(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    return t.groupBy(X.first_rule([(F.nullif(t.angle, F.lit(7)).isNull(), "no_angle"), (t.value > 0.08, "value"), (t.tax < 0.02, "tax")], "kept").alias("reason")).agg(F.count("*").alias("n"))


@query("tri_state_bool", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN false END AS flag FROM customer")
def tri_state_bool(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    text = F.when(c.c_custkey % 3 == 0, " True ").when(c.c_custkey % 3 == 1, "FALSE").otherwise("NA")
    return c.select("c_custkey", X.tri_state(text).alias("flag"))


@query("winsorise_clip", f"WITH {TURNS} SELECT grp, round(sum(greatest(5.0, least(angle, 45.0))), 2) AS total, count(*) FILTER (WHERE angle < 5 OR angle > 45) AS clipped FROM t GROUP BY 1")
def winsorise_clip(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    return t.groupBy("grp").agg(F.round(F.sum(X.clip(t.angle, 5.0, 45.0)), 2).alias("total"), F.count_if((t.angle < 5) | (t.angle > 45)).alias("clipped"))


@query("rare_level_pooling", "WITH c AS (SELECT *, count(*) OVER (PARTITION BY n_name) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT CASE WHEN n < 62 THEN 'OTHER' ELSE n_name END AS level, count(*) AS rows FROM c GROUP BY 1")
def rare_level_pooling(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    n = F.count("*").over(Window.partitionBy("n_name"))
    return c.withColumn("n", n).groupBy(F.when(F.col("n") < 62, "OTHER").otherwise(F.col("n_name")).alias("level")).agg(F.count("*").alias("rows"))


@query("range_sanitise", "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END AS balance FROM customer")
def range_sanitise(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select("c_custkey", F.when(c.c_acctbal.between(0, 5000), c.c_acctbal).alias("balance"))


@query("clock_to_seconds", """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE printf('%02d:%02d', o_orderkey % 15, o_orderkey % 60) END AS clock, CAST(1 + o_orderkey % 5 AS INTEGER) AS quarter FROM orders),
 s AS (SELECT o_orderkey, quarter, CASE WHEN clock <> 'bad' THEN CAST(o_orderkey % 15 * 60 + o_orderkey % 60 AS INTEGER) END AS seconds FROM c)
 SELECT o_orderkey, seconds, CAST(CASE WHEN quarter >= 5 THEN 3600 + (quarter - 5) * 600 + 600 - seconds ELSE (quarter - 1) * 900 + 900 - seconds END AS INTEGER) AS elapsed FROM s""")
def clock_to_seconds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select("o_orderkey", F.when(k % 7 == 0, "bad").otherwise(F.format_string("%02d:%02d", k % 15, k % 60)).alias("clock"), (1 + k % 5).cast("int").alias("quarter"))
    o = o.select("o_orderkey", X.clock_seconds(F.col("clock")).alias("seconds"), "quarter")
    return o.select("o_orderkey", "seconds", X.elapsed(F.col("quarter"), F.col("seconds")).cast("int").alias("elapsed"))


@query("leverage_index", f"WITH {TURNS} SELECT play, line, player, part, round(4 * (value * 10) * (1 - value * 10), 9) AS leverage FROM t")
def leverage_index(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("value") * 10
    return turns(spark, d).select(*K, F.round(4 * p * (1 - p), 9).alias("leverage"))


@query("field_geometry", """WITH o AS (SELECT o_orderkey, o_orderstatus AS side, nullif(CAST(o_orderkey % 50 AS INTEGER), 0) AS number, CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS dir, o_custkey % 120 AS x FROM orders)
 SELECT o_orderkey, CASE WHEN number IS NULL THEN NULL WHEN side = 'F' THEN 10 + number ELSE 110 - number END AS los,
 CASE WHEN number IS NULL THEN NULL WHEN dir = 'right' THEN 110 - CASE WHEN side = 'F' THEN 10 + number ELSE 110 - number END ELSE CASE WHEN side = 'F' THEN 10 + number ELSE 110 - number END - 10 END AS to_goal,
 CASE WHEN dir = 'right' THEN 1 ELSE -1 END * (x - CASE WHEN side = 'F' THEN 10 + number ELSE 110 - number END) AS depth FROM o""")
def field_geometry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("side"), F.nullif((k % 50).cast("int"), F.lit(0)).alias("number"), F.when(k % 2 == 0, "left").otherwise("right").alias("dir"), (F.col("o_custkey") % 120).alias("x"))
    los = F.when(F.col("side") == "F", 10 + F.col("number")).otherwise(110 - F.col("number"))
    return o.withColumn("los", los).select("o_orderkey", "los", F.when(F.col("dir") == "right", 110 - F.col("los")).otherwise(F.col("los") - 10).alias("to_goal"), (F.when(F.col("dir") == "right", 1).otherwise(-1) * (F.col("x") - F.col("los"))).alias("depth"))


@query("score_margin_by_side", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 31 - o_custkey % 29 WHEN o_orderstatus = 'O' THEN o_custkey % 29 - o_orderkey % 31 END AS margin FROM orders")
def score_margin_by_side(spark: SparkSession, d: str) -> DataFrame:
    h, v, team = F.col("o_orderkey") % 31, F.col("o_custkey") % 29, F.col("o_orderstatus")
    return read(spark, d, "orders").select("o_orderkey", F.when(team == "F", h - v).when(team == "O", v - h).alias("margin"))


@query("context_rule_mask", "SELECT o_orderkey % 4 = 3 AND abs(o_custkey % 60 - 30) > 16 AS garbage, o_orderkey % 2 = 1 AND o_custkey % 900 < 120 AS late, o_orderkey % 4 >= 2 AND o_custkey % 15 >= 7 AS passing, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def context_rule_mask(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, d, "orders").groupBy(((k % 4 == 3) & (F.abs(c % 60 - 30) > 16)).alias("garbage"), ((k % 2 == 1) & (c % 900 < 120)).alias("late"), ((k % 4 >= 2) & (c % 15 >= 7)).alias("passing")).agg(F.count("*").alias("n"))


@query("survival_row", f"""WITH {TURNS}, s AS (SELECT play, line, player, part, nullif(angle, 13) AS ev, value * 400 AS cens FROM t)
 SELECT play, line, player, part, round(CASE WHEN ev IS NOT NULL AND ev <= cens THEN ev ELSE cens END, 6) AS observed, ev IS NOT NULL AND ev <= cens AS event, CASE WHEN ev IS NULL THEN 'none' WHEN ev <= cens THEN 'event' ELSE 'censored' END AS status FROM s""")
def survival_row(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).withColumn("ev", F.nullif("angle", F.lit(13))).withColumn("cens", F.col("value") * 400)
    hit = F.coalesce(F.col("ev") <= F.col("cens"), F.lit(False))
    return t.select(*K, F.round(F.when(hit, F.col("ev")).otherwise(F.col("cens")), 6).alias("observed"), hit.alias("event"), F.when(F.col("ev").isNull(), "none").when(hit, "event").otherwise("censored").alias("status"))


@query("season_from_key", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CAST(year(o_orderdate) AS INTEGER), CAST(floor(l_orderkey / 1000) AS INTEGER)) AS season FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey")
def season_from_key(spark: SparkSession, d: str) -> DataFrame:
    games = read(spark, d, "orders").where("o_orderstatus != 'P'").select("o_orderkey", F.year("o_orderdate").alias("y"))
    t = read(spark, d, "lineitem").join(games, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("y", F.floor(F.col("l_orderkey") / 1000).cast("int")).alias("season"))


@query("friction_circle_demand", f"WITH {TURNS} SELECT play, line, player, part, round(sqrt(power(greatest(angle - 20, 0), 2) + power(greatest(abs(value * 100), abs(tax * 100)), 2)), 6) AS demand FROM t")
def friction_circle_demand(spark: SparkSession, d: str) -> DataFrame:
    lat, a, b = F.col("angle") - 20, F.col("value") * 100, F.col("tax") * 100
    return turns(spark, d).select(*K, F.round(F.hypot(F.greatest(lat, F.lit(0.0)), F.greatest(F.abs(a), F.abs(b))), 6).alias("demand"))


@query("fn_angles", f"WITH {TURNS} SELECT play, line, player, part, round(((angle * 20 + 180) % 360) - 180, 6) AS wrapped, round((degrees(atan2(angle - 25, value - 0.05)) + 360) % 360, 6) AS heading FROM t")
def fn_angles(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    return t.select(*K, F.round(X.wrap(t.angle * 20), 6).alias("wrapped"), F.round(X.heading(t.angle - 25, t.value - 0.05), 6).alias("heading"))


@query("fn_distance", f"WITH {TURNS} SELECT play, line, player, part, round(sqrt(power(angle, 2) + power(value * 100, 2)), 6) AS distance FROM t")
def fn_distance(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select(*K, F.round(F.hypot("angle", F.col("value") * 100), 6).alias("distance"))


@query("fn_safe_ratio", f"WITH {TURNS} SELECT play, line, player, part, round(CASE WHEN abs(value) > 1e-9 THEN tax / value END, 6) AS ratio FROM t")
def fn_safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select(*K, F.round(X.ratio(F.col("tax"), F.col("value")), 6).alias("ratio"))


@query("fn_regex_extract", "WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,6}[ ,]', 0)) AS hit FROM documents) SELECT doc_id, hit, count(*) AS n FROM d GROUP BY 1, 2")
def fn_regex_extract(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,6}[ ,]"), F.lit(0))).alias("hit"))
    return hits.groupBy("doc_id", "hit").agg(F.count("*").alias("n"))


@query("fn_name_normalise", "WITH p AS (SELECT p_partkey, list_filter(string_split(lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' Jr' ELSE '' END), ' '), lambda x: x NOT IN ('jr', 'sr', 'ii', 'iii', 'iv', '')) AS w FROM part) SELECT p_partkey, regexp_replace(w[-1], '[^a-z]', '', 'g') AS surname FROM p")
def fn_name_normalise(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " Jr").otherwise(""))
    return read(spark, d, "part").select("p_partkey", X.name_key(full).alias("surname"))


@query("fn_keyword_flags", "SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'rights reserved') AS legal, contains(lower(text), 'password') AS secret FROM documents")
def fn_keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    low = read(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", (F.contains("low", F.lit("license")) | F.contains("low", F.lit("rights reserved"))).alias("legal"), F.contains("low", F.lit("password")).alias("secret"))


@query("fn_integer_check", f"WITH {TURNS} SELECT grp, round(avg(CASE WHEN abs(30 * sqrt(value) - round(30 * sqrt(value))) < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share FROM t GROUP BY 1")
def fn_integer_check(spark: SparkSession, d: str) -> DataFrame:
    v = 30 * F.sqrt("value")
    return turns(spark, d).groupBy("grp").agg(F.round(F.avg((F.abs(v - F.round(v)) < 0.05).cast("double")), 6).alias("share"))


@query("fn_hash_split", "SELECT c_custkey, CAST(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 18, 15) AS UBIGINT) % 8 AS INTEGER) AS part FROM customer")
def fn_hash_split(spark: SparkSession, d: str) -> DataFrame:
    digits = F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 18, 15)
    return read(spark, d, "customer").select("c_custkey", (F.conv(digits, 16, 10).cast("bigint") % 8).cast("int").alias("part"))


@query("fn_date_parts", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, epoch_ms(o_orderdate) AS ms, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE month(o_orderdate) IN (3, 9)")
def fn_date_parts(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where(F.month("o_orderdate").isin(3, 9))
    text = F.date_format(F.col("o_orderdate"), "dd/MM/yyyy")
    return o.select("o_orderkey", F.month("o_orderdate").alias("month"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))").alias("ms"), F.to_date(text, "dd/MM/yyyy").cast("string").alias("day"))


@query("fn_fuzzy_similarity", "SELECT p_partkey, round(1 - levenshtein(p_name, p_brand) / CAST(greatest(length(p_name), length(p_brand), 1) AS DOUBLE), 6) AS similarity FROM part")
def fn_fuzzy_similarity(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(X.similarity(F.col("p_name"), F.col("p_brand")), 6).alias("similarity"))
