"""Queries of section 2.4: aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swerve.functions import columns as X
from swerve.operators import aggregates as A
from swerve.operators import stats as S
from swerve.sources.tables import FRAMES, TURNS, frames, read, turns

from .columns import BAND_SQL, EDGES
from .joining import TEAM, with_team
from .registry import query

c = F.col
K = ["play", "line", "player", "part"]


def R(x, n: int = 6):
    return F.round(x, n)


@query("agg_band_supply_demand", f"""WITH {TURNS}, b AS (SELECT grp, setting, {BAND_SQL} AS band FROM t), n AS (SELECT grp, band, count(*) FILTER (WHERE setting = 'F') AS n_supply, count(*) FILTER (WHERE setting = 'O') AS n_demand FROM b WHERE band IS NOT NULL GROUP BY 1, 2),
 s AS (SELECT *, CASE WHEN sum(n_supply) OVER w > 0 THEN n_supply / (sum(n_supply) OVER w)::DOUBLE END AS ss, CASE WHEN sum(n_demand) OVER w > 0 THEN n_demand / (sum(n_demand) OVER w)::DOUBLE END AS sd FROM n WINDOW w AS (PARTITION BY grp))
 SELECT grp, band, n_supply, n_demand, round(ss, 9) AS share_supply, round(sd, 9) AS share_demand, round(CASE WHEN ss > 0 THEN sd / ss END, 9) AS share_ratio FROM s""")
def agg_band_supply_demand(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    out = A.supply_and_demand(t, "setting", "grp", X.band(t.angle, EDGES), "F", "O")
    return out.select("grp", "band", "n_supply", "n_demand", *[R(k, 9).alias(k) for k in ("share_supply", "share_demand", "share_ratio")])


@query("agg_conditional_count", f"WITH {TURNS} SELECT grp, count(*) AS n, count(*) FILTER (WHERE angle >= 30) AS sharp, count(*) FILTER (WHERE value > 0.05 AND tax > 0.04) AS both FROM t GROUP BY 1")
def agg_conditional_count(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.count_if(c("angle") >= 30).alias("sharp"), F.count_if((c("value") > 0.05) & (c("tax") > 0.04)).alias("both"))


@query("agg_count_distinct_tuple", f"WITH {TURNS} SELECT grp, count(DISTINCT (play, line)) AS short_key, count(DISTINCT (play, line, player)) AS long_key FROM t GROUP BY 1")
def agg_count_distinct_tuple(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("grp").agg(F.countDistinct("play", "line").alias("short_key"), F.countDistinct("play", "line", "player").alias("long_key"))


@query("agg_quantiles_exact", f"WITH {TURNS} SELECT grp, setting, round(quantile_cont(price, 0.25), 4) AS q25, round(quantile_cont(price, 0.5), 4) AS q50, round(quantile_cont(price, 0.9), 4) AS q90 FROM t GROUP BY 1, 2")
def agg_quantiles_exact(spark: SparkSession, d: str) -> DataFrame:
    q = S.quantiles(turns(spark, d), ["grp", "setting"], "price", [0.25, 0.5, 0.9])
    return q.select("grp", "setting", *[R(f"q{k}", 4).alias(n) for k, n in enumerate(("q25", "q50", "q90"))])


@query("agg_drill_summary", f"WITH {TURNS}, a AS (SELECT o_orderpriority AS drill, count(*) AS attempts FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS drill, count(*) AS turns, round(quantile_cont(angle, 0.5), 4) AS median_angle, round(avg(CASE WHEN angle >= 30 THEN 1.0 ELSE 0 END), 6) AS sharp FROM t JOIN orders ON play = o_orderkey WHERE angle >= 5 GROUP BY 1) SELECT drill, attempts, coalesce(turns, 0) AS turns, median_angle, sharp, round(coalesce(turns, 0) / attempts::DOUBLE, 6) AS per_attempt FROM a LEFT JOIN b USING (drill)")
def agg_drill_summary(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(c("o_orderkey").alias("play"), c("o_orderpriority").alias("drill"))
    b = turns(spark, d).where("angle >= 5").join(o, "play").groupBy("drill").agg(F.count("*").alias("turns"), R(F.percentile("angle", 0.5), 4).alias("median_angle"), R(F.avg((c("angle") >= 30).cast("double"))).alias("sharp"))
    out = o.groupBy("drill").agg(F.count("*").alias("attempts")).join(b, "drill", "left").withColumn("turns", F.coalesce("turns", F.lit(0).cast("long")))
    return out.select("drill", "attempts", "turns", "median_angle", "sharp", R(c("turns") / c("attempts")).alias("per_attempt"))


@query("agg_group_any_or_null", f"WITH {TURNS} SELECT play, min(CASE WHEN grp <> 'N' THEN grp END) AS label, count(DISTINCT CASE WHEN grp <> 'N' THEN grp END) AS n_labels FROM t GROUP BY 1")
def agg_group_any_or_null(spark: SparkSession, d: str) -> DataFrame:
    g = F.when(c("grp") != "N", c("grp"))
    return turns(spark, d).groupBy("play").agg(F.min(g).alias("label"), F.countDistinct(g).alias("n_labels"))


@query("agg_mode_value", f"WITH {TURNS}, n AS (SELECT player, angle, count(*) AS n FROM t GROUP BY 1, 2) SELECT player, angle, n FROM n QUALIFY row_number() OVER (PARTITION BY player ORDER BY n DESC, angle) = 1")
def agg_mode_value(spark: SparkSession, d: str) -> DataFrame:
    return A.mode(turns(spark, d), ["player"], "angle")


@query("agg_histogram_fixed", f"WITH {TURNS}, b AS (SELECT grp, CAST(least(floor((angle - 10) / 5), 6) AS INTEGER) AS bin FROM t WHERE angle BETWEEN 10 AND 45), n AS (SELECT grp, bin, count(*) AS n FROM b GROUP BY 1, 2) SELECT grp, bin, n, round(n / (sum(n) OVER (PARTITION BY grp))::DOUBLE, 9) AS share FROM n")
def agg_histogram_fixed(spark: SparkSession, d: str) -> DataFrame:
    n = A.histogram(turns(spark, d), ["grp"], "angle", 10, 5, 7)
    return n.withColumn("share", R(c("n") / F.sum("n").over(Window.partitionBy("grp")), 9))


HIST = "n AS (SELECT grp, least(floor(angle / 5), 9) AS bin, count(*) AS n FROM t WHERE angle BETWEEN 0 AND 50 GROUP BY 1, 2), cum AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY grp) AS total FROM n)"


@query("agg_histogram_percentile", f"WITH {TURNS}, {HIST} SELECT grp, round(bin * 5 + 5 * (0.9 * total - (upto - n)) / n, 6) AS p90 FROM cum WHERE upto >= 0.9 * total AND upto - n < 0.9 * total")
def agg_histogram_percentile(spark: SparkSession, d: str) -> DataFrame:
    n = A.histogram(turns(spark, d), ["grp"], "angle", 0, 5, 10)
    w = Window.partitionBy("grp")
    n = n.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w)).where("upto >= 0.9 * total and upto - n < 0.9 * total")
    return n.select("grp", R(c("bin") * 5 + 5 * (0.9 * c("total") - (c("upto") - c("n"))) / c("n")).alias("p90"))


@query("agg_histogram_overlap", f"WITH {TURNS}, n AS (SELECT grp, least(floor(angle / 5), 9) AS bin, count(*) FILTER (WHERE setting = 'F') AS a, count(*) FILTER (WHERE setting = 'O') AS b FROM t WHERE angle BETWEEN 0 AND 50 GROUP BY 1, 2), s AS (SELECT grp, a / nullif(sum(a) OVER (PARTITION BY grp), 0)::DOUBLE AS p, b / nullif(sum(b) OVER (PARTITION BY grp), 0)::DOUBLE AS q FROM n), l AS (SELECT grp, quantile_cont(angle, 0.05) AS lo, quantile_cont(angle, 0.95) AS hi FROM t WHERE setting = 'F' AND angle BETWEEN 0 AND 50 GROUP BY 1), i AS (SELECT t.grp, avg(CASE WHEN angle BETWEEN lo AND hi THEN 1.0 ELSE 0 END) AS inside FROM t JOIN l ON t.grp = l.grp WHERE setting = 'O' AND angle BETWEEN 0 AND 50 GROUP BY 1), o AS (SELECT grp, round(sum(CASE WHEN p IS NULL OR q IS NULL THEN 0 ELSE least(p, q) END), 9) AS overlap FROM s GROUP BY 1) SELECT o.grp, overlap, round(inside, 9) AS inside FROM o LEFT JOIN i ON o.grp = i.grp")
def agg_histogram_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).where("angle between 0 and 50")
    n = t.groupBy("grp", F.least(F.floor(c("angle") / 5), F.lit(9)).alias("bin")).agg(F.count_if(c("setting") == "F").alias("a"), F.count_if(c("setting") == "O").alias("b"))
    w = Window.partitionBy("grp")
    part = lambda k: c(k) / F.nullif(F.sum(k).over(w), F.lit(0))
    s = n.select("grp", part("a").alias("p"), part("b").alias("q"))
    range_ = t.where("setting = 'F'").groupBy("grp").agg(F.percentile("angle", 0.05).alias("lo"), F.percentile("angle", 0.95).alias("hi"))
    inside = t.where("setting = 'O'").join(F.broadcast(range_), "grp").groupBy("grp").agg(R(F.avg(c("angle").between(c("lo"), c("hi")).cast("double")), 9).alias("inside"))
    return s.groupBy("grp").agg(R(F.sum(F.when(c("p").isNull() | c("q").isNull(), 0.0).otherwise(F.least("p", "q"))), 9).alias("overlap")).join(inside, "grp", "left")


@query("agg_field_availability", f"WITH {TURNS}, n AS (SELECT grp, count(*) AS rows, count(nullif(angle, 13)) AS angle, count(nullif(value, 0)) AS value, count(tax) AS tax FROM t GROUP BY 1) SELECT grp, field, n, round(n / rows::DOUBLE, 9) AS share FROM (UNPIVOT n ON angle, value, tax INTO NAME field VALUE n)")
def agg_field_availability(spark: SparkSession, d: str) -> DataFrame:
    n = turns(spark, d).groupBy("grp").agg(F.count("*").alias("rows"), F.count(F.nullif("angle", F.lit(13))).alias("angle"), F.count(F.nullif("value", F.lit(0))).alias("value"), F.count("tax").alias("tax"))
    return A.unpivot(n, ["grp", "rows"], ["angle", "value", "tax"], "field", "n").select("grp", "field", "n", R(c("n") / c("rows"), 9).alias("share"))


@query("agg_null_profile", f"WITH {TURNS} SELECT 'angle' AS name, 'double' AS dtype, count(*) - count(nullif(angle, 13)) AS nulls, min(nullif(angle, 13)) AS lo, max(nullif(angle, 13)) AS hi, count(DISTINCT nullif(angle, 13)) AS n_distinct FROM t UNION ALL SELECT 'tax', 'double', count(*) - count(tax), min(tax), max(tax), count(DISTINCT tax) FROM t")
def agg_null_profile(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).withColumn("angle", F.nullif("angle", F.lit(13)))
    long = A.unpivot(t.select("angle", "tax"), [], ["angle", "tax"])
    types = F.create_map(*[F.lit(x) for pair in t.select("angle", "tax").dtypes for x in pair])
    return long.groupBy("name", types[c("name")].alias("dtype")).agg(F.count_if(c("value").isNull()).alias("nulls"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.countDistinct("value").alias("n_distinct"))


@query("agg_cooccurrence", f"WITH {TURNS} SELECT grp, setting, count(*) AS n FROM t GROUP BY 1, 2")
def agg_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("grp", "setting").agg(F.count("*").alias("n"))


@query("agg_exposure_rates", f"WITH {TURNS}, p AS (SELECT player, count(*) AS turns, count(DISTINCT play) AS plays FROM t WHERE angle >= 30 GROUP BY 1) SELECT count(*) AS players, round(avg(turns), 6) AS per_player, round(sum(turns) / sum(plays)::DOUBLE, 6) AS per_play, round(avg(CASE WHEN turns >= 100 THEN 1.0 ELSE 0 END), 6) AS at_least FROM p")
def agg_exposure_rates(spark: SparkSession, d: str) -> DataFrame:
    p = turns(spark, d).where("angle >= 30").groupBy("player").agg(F.count("*").alias("turns"), F.countDistinct("play").alias("plays"))
    return p.agg(F.count("*").alias("players"), R(F.avg("turns")).alias("per_player"), R(F.sum("turns") / F.sum("plays")).alias("per_play"), R(F.avg((c("turns") >= 100).cast("double"))).alias("at_least"))


@query("agg_participation_share", f"WITH {TURNS}, {TEAM}, a AS (SELECT team, count(DISTINCT play) AS plays FROM p GROUP BY 1), b AS (SELECT team, player, count(DISTINCT play) AS own FROM p GROUP BY 1, 2) SELECT player, round(own / plays::DOUBLE, 9) AS share, CASE WHEN own / plays::DOUBLE >= 0.25 THEN 'regular' ELSE 'spare' END AS bucket FROM a JOIN b USING (team)")
def agg_participation_share(spark: SparkSession, d: str) -> DataFrame:
    p = with_team(spark, d)
    a, b = p.groupBy("team").agg(F.countDistinct("play").alias("plays")), p.groupBy("team", "player").agg(F.countDistinct("play").alias("own"))
    share = c("own") / c("plays")
    return a.join(b, "team").select("player", R(share, 9).alias("share"), F.when(share >= 0.25, "regular").otherwise("spare").alias("bucket"))


@query("agg_min_cut_sensitivity", f"WITH {TURNS}, p AS (SELECT player, count(*) AS n FROM t WHERE angle >= 40 GROUP BY 1) SELECT cut, count(*) FILTER (WHERE n >= cut) AS players, coalesce(sum(n) FILTER (WHERE n >= cut), 0)::BIGINT AS rows FROM p, (SELECT unnest([50, 100, 120, 140]) AS cut) GROUP BY 1")
def agg_min_cut_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    p = turns(spark, d).where("angle >= 40").groupBy("player").agg(F.count("*").alias("n")).withColumn("cut", F.explode(F.array(*map(F.lit, (50, 100, 120, 140)))))
    return p.groupBy("cut").agg(F.count_if(c("n") >= c("cut")).alias("players"), F.coalesce(F.sum(F.when(c("n") >= c("cut"), c("n"))), F.lit(0).cast("long")).alias("rows"))


STEP = "s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step, h - lag(h) OVER w AS dt FROM e WINDOW w AS (PARTITION BY track ORDER BY us, id))"


def steps(e: DataFrame) -> DataFrame:
    w = Window.partitionBy("track").orderBy("us", "id")
    step = F.sqrt(F.pow(c("x") - F.lag("x").over(w), 2) + F.pow(c("y") - F.lag("y").over(w), 2))
    return e.withColumn("step", step).withColumn("dt", c("h") - F.lag("h").over(w))


@query("agg_track_summary", f"WITH {FRAMES}, {STEP} SELECT track, round(max(step / nullif(dt, 0)), 4) AS max_speed, round(sum(step), 4) AS path, round(sqrt(power(arg_max(x, (us, id)) - arg_min(x, (us, id)), 2) + power(arg_max(y, (us, id)) - arg_min(y, (us, id)), 2)), 4) AS displacement, round(max(h) - min(h), 4) AS hours, round(quantile_cont(dt, 0.5), 4) AS median_gap FROM s GROUP BY 1")
def agg_track_summary(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("us", "id")
    gap = lambda k: F.pow(F.max_by(k, at) - F.min_by(k, at), 2)
    return steps(frames(spark, d)).groupBy("track").agg(R(F.max(c("step") / F.nullif("dt", F.lit(0.0))), 4).alias("max_speed"), R(F.sum("step"), 4).alias("path"), R(F.sqrt(gap("x") + gap("y")), 4).alias("displacement"), R(F.max("h") - F.min("h"), 4).alias("hours"), R(F.percentile("dt", 0.5), 4).alias("median_gap"))


@query("agg_circular_mean", f"WITH {TURNS}, m AS (SELECT grp, avg(sin(radians(angle * 3))) AS s, avg(cos(radians(angle * 3))) AS c FROM t GROUP BY 1), d AS (SELECT grp, (degrees(atan2(s, c)) + 360) % 360 AS mean, degrees(sqrt(-2 * ln(sqrt(s * s + c * c)))) AS sd FROM m) SELECT d.grp, round(any_value(mean), 5) AS mean, round(any_value(sd), 5) AS sd, round(avg(CASE WHEN abs((angle * 3 - mean + 540) % 360 - 180) <= 30 THEN 1.0 ELSE 0 END), 9) AS within_30 FROM d JOIN t ON d.grp = t.grp GROUP BY 1")
def agg_circular_mean(spark: SparkSession, d: str) -> DataFrame:
    a = F.radians(c("angle") * 3)
    m = turns(spark, d).groupBy("grp").agg(F.avg(F.sin(a)).alias("s"), F.avg(F.cos(a)).alias("c"))
    m = m.select("grp", F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)).alias("mean"), F.degrees(F.sqrt(-2 * F.log(F.hypot("s", "c")))).alias("sd"))
    near = F.abs(X.wrap(c("angle") * 3 - c("mean"))) <= 30
    return turns(spark, d).join(F.broadcast(m), "grp").groupBy("grp").agg(R(F.first("mean"), 5).alias("mean"), R(F.first("sd"), 5).alias("sd"), R(F.avg(near.cast("double")), 9).alias("within_30"))


CELL = "g AS (SELECT *, floor(angle / 10) AS cell FROM t)"


def cells(t: DataFrame) -> DataFrame:
    return t.withColumn("cell", F.floor(c("angle") / 10))


@query("agg_weighted_share_grid", f"WITH {TURNS}, {CELL}, m AS (SELECT grp, 'count' AS mode, cell, 1.0 AS w, player FROM g UNION ALL SELECT grp, 'price', cell, price, player FROM g), n AS (SELECT grp, mode, cell, sum(w) AS weight, count(DISTINCT player) AS players FROM m GROUP BY 1, 2, 3) SELECT grp, mode, cell::BIGINT AS cell, players, round(weight / sum(weight) OVER (PARTITION BY grp, mode), 9) AS share FROM n")
def agg_weighted_share_grid(spark: SparkSession, d: str) -> DataFrame:
    modes = F.explode(F.array(F.struct(F.lit("count").alias("mode"), F.lit(1.0).alias("w")), F.struct(F.lit("price").alias("mode"), c("price").alias("w"))))
    n = cells(turns(spark, d)).select("grp", "cell", "player", modes.alias("m")).groupBy("grp", "m.mode", "cell").agg(F.sum("m.w").alias("weight"), F.countDistinct("player").alias("players"))
    return n.select("grp", "mode", "cell", "players", R(c("weight") / F.sum("weight").over(Window.partitionBy("grp", "mode")), 9).alias("share"))


@query("agg_coverage_ratio", f"WITH {TURNS}, {CELL}, r AS (SELECT cell, avg(value) >= 0.05 AS inside, count(*) AS n FROM g WHERE setting = 'F' AND grp = 'A' GROUP BY 1), o AS (SELECT cell, inside, n >= (SELECT avg(n) FROM r) AS observed FROM r) SELECT g.grp, scope, round(sum(CASE WHEN inside AND (scope = 'combined' OR observed = (scope = 'observed')) THEN price ELSE 0 END) / sum(price), 9) AS coverage FROM g LEFT JOIN o ON g.cell = o.cell, (SELECT unnest(['observed', 'extrapolated', 'combined']) AS scope) WHERE setting = 'O' GROUP BY 1, 2")
def agg_coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    g = cells(turns(spark, d))
    region = g.where("setting = 'F' and grp = 'A'").groupBy("cell").agg((F.avg("value") >= 0.05).alias("inside"), F.count("*").alias("n"))
    region = region.crossJoin(F.broadcast(region.agg(F.avg("n").alias("mean")))).select("cell", "inside", (c("n") >= c("mean")).alias("observed"))  # cells with data enough
    demand = g.where("setting = 'O'").groupBy("grp", "cell").agg(F.sum("price").alias("price")).join(F.broadcast(region), "cell", "left")
    scopes = demand.withColumn("scope", F.explode(F.array(*map(F.lit, ("observed", "extrapolated", "combined")))))
    counts = c("inside") & ((c("scope") == "combined") | (c("observed") == (c("scope") == "observed")))
    return scopes.groupBy("grp", "scope").agg(R(F.sum(F.when(counts, c("price")).otherwise(0.0)) / F.sum("price"), 9).alias("coverage"))


@query("agg_group_rollup_all", f"WITH {TURNS} SELECT grp, coalesce(setting, 'all') AS role, count(*) AS n FROM t GROUP BY GROUPING SETS ((grp, setting), (grp))")
def agg_group_rollup_all(spark: SparkSession, d: str) -> DataFrame:
    g = turns(spark, d).groupingSets([["grp", "setting"], ["grp"]], "grp", "setting").agg(F.count("*").alias("n"))
    return g.select("grp", F.coalesce("setting", F.lit("all")).alias("role"), "n")


@query("agg_season_rollup", f"WITH {TURNS} SELECT season, count(*) AS n, count(DISTINCT player) AS players FROM t GROUP BY ROLLUP (season)")
def agg_season_rollup(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).rollup("season").agg(F.count("*").alias("n"), F.countDistinct("player").alias("players"))


@query("agg_pair_class", f"WITH {TURNS}, p AS (SELECT play, count(*) AS n, min(grp) AS a, max(grp) AS b FROM t GROUP BY 1) SELECT a || '+' || b AS pair, count(*) AS plays FROM p WHERE n = 2 GROUP BY 1")
def agg_pair_class(spark: SparkSession, d: str) -> DataFrame:
    p = turns(spark, d).groupBy("play").agg(F.count("*").alias("n"), F.min("grp").alias("a"), F.max("grp").alias("b")).where("n = 2")
    return p.groupBy(F.concat_ws("+", "a", "b").alias("pair")).agg(F.count("*").alias("plays"))


@query("agg_string_set", f"WITH {TURNS} SELECT play, array_to_string(list_sort(list(DISTINCT player)), ';') AS players FROM t GROUP BY 1")
def agg_string_set(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("play").agg(F.array_join(F.array_sort(F.collect_set("player")).cast("array<string>"), ";").alias("players"))


@query("agg_agreement_rate", f"WITH {TURNS}, a AS (SELECT play, CASE WHEN count(*) FILTER (WHERE angle >= 40) = 1 THEN min(player) FILTER (WHERE angle >= 40) END AS x, CASE WHEN count(*) FILTER (WHERE value >= 0.08) = 1 THEN min(player) FILTER (WHERE value >= 0.08) END AS y FROM t GROUP BY 1) SELECT CASE WHEN x IS NULL OR y IS NULL THEN 'ambiguous' WHEN x = y THEN 'agree' ELSE 'disagree' END AS status, count(*) AS n FROM a GROUP BY 1")
def agg_agreement_rate(spark: SparkSession, d: str) -> DataFrame:
    one = lambda rule: F.when(F.count_if(rule) == 1, F.min(F.when(rule, c("player"))))
    a = turns(spark, d).groupBy("play").agg(one(c("angle") >= 40).alias("x"), one(c("value") >= 0.08).alias("y"))
    return a.groupBy(F.when(c("x").isNull() | c("y").isNull(), "ambiguous").when(c("x") == c("y"), "agree").otherwise("disagree").alias("status")).agg(F.count("*").alias("n"))


@query("agg_bucket_distribution", f"WITH {TURNS}, b AS (SELECT {BAND_SQL} AS bucket, count(*) AS n FROM t GROUP BY 1) SELECT coalesce(bucket, 'none') AS bucket, n, round(n / (sum(n) FILTER (WHERE bucket IS NOT NULL) OVER ())::DOUBLE, 9) AS of_evaluated, round(n / (sum(n) OVER ())::DOUBLE, 9) AS of_all FROM b")
def agg_bucket_distribution(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    b = t.groupBy(X.band(t.angle, EDGES).alias("bucket")).agg(F.count("*").alias("n"))
    whole = F.broadcast(b.agg(F.sum("n").alias("everything"), F.sum(F.when(c("bucket").isNotNull(), c("n"))).alias("evaluated")))
    return b.crossJoin(whole).select(F.coalesce("bucket", F.lit("none")).alias("bucket"), "n", R(c("n") / c("evaluated"), 9).alias("of_evaluated"), R(c("n") / c("everything"), 9).alias("of_all"))


@query("agg_region_signature", f"WITH {TURNS}, g AS (SELECT player, CAST(floor(angle / 10) AS BIGINT) AS cell, count(*) FILTER (WHERE value > 0.05) AS s, count(*) AS n FROM t WHERE angle >= 10 GROUP BY 1, 2), p AS (SELECT player, sha256(string_agg(cell || ':' || CAST(round(1e12 * s / n) AS BIGINT), ',' ORDER BY cell)) AS signature FROM g GROUP BY 1) SELECT signature, min(player) AS first_player, count(*) AS players, dense_rank() OVER (ORDER BY signature) AS region FROM p GROUP BY signature")
def agg_region_signature(spark: SparkSession, d: str) -> DataFrame:
    """Players with the same shares, to 12 places, in the same cells; regions are numbered in the order of their
    signatures: within one of 256 ranges of them, after the numbers of the ranges before."""
    g = cells(turns(spark, d).where("angle >= 10")).groupBy("player", "cell").agg(F.count_if(c("value") > 0.05).alias("s"), F.count("*").alias("n"))
    share = F.concat_ws(":", "cell", F.round(1e12 * c("s") / c("n")).cast("long"))
    s = g.groupBy("player").agg(F.array_sort(F.collect_list(F.struct("cell", share.alias("share")))).alias("grid"))
    s = s.select("player", F.sha2(F.array_join(F.transform("grid", lambda x: x["share"]), ","), 256).alias("signature"))
    s = s.groupBy("signature").agg(F.min("player").alias("first_player"), F.count("*").alias("players")).withColumn("range", F.substring("signature", 1, 2))
    before = s.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # 256 rows at most
    number = F.row_number().over(Window.partitionBy("range").orderBy("signature"))
    return s.join(F.broadcast(before), "range").select("signature", "first_player", "players", (c("before") + number).alias("region"))
