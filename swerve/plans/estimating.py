"""Queries of section 2.12: statistics as distributed jobs on the turn rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swerve.functions.columns import band, hash_uniform
from swerve.operators import replicates as B
from swerve.operators import stats as S
from swerve.sources.tables import TURNS, read, turns

from .aggregating import R, cells
from .columns import EDGES
from .ordering import HALF, halves
from .registry import query

c = F.col
TAU2 = 4e6
REPS, SEED = 2000, 17  # the reference's least number of draws for a percentile interval
MOM = "m AS (SELECT grp, player, count(*) AS n, avg(price) AS mean, var_pop(price) * count(*) AS ss FROM t GROUP BY 1, 2)"
ICC = "a AS (SELECT grp, count(*) AS j, sum(n) AS total, sum(n * n) AS n2, sum(n * mean) AS nm, sum(n * mean * mean) AS nm2, sum(ss) AS ssw FROM m GROUP BY 1), i AS (SELECT grp, (total - n2 / total::DOUBLE) / (j - 1) AS k0, (nm2 - nm * nm / total) / (j - 1) AS msb, ssw / (total - j) AS msw FROM a)"


def moments(spark: SparkSession, d: str, by: tuple[str, ...] = ("grp", "player")) -> DataFrame:
    return S.group_moments(turns(spark, d), list(by), "price")


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def coefficients(spark: SparkSession, fit: dict, model: str = "ols", skip: tuple[str, ...] = ()) -> DataFrame:
    rows = [(model, n, *(round(float(v), 3) for v in (b, e, m)), fit["n"], round(float(fit["r2"]), 6)) for n, b, e, m in zip(fit["names"], fit["beta"], fit["se"], fit["mde"], strict=True) if n not in skip]
    return table_of(spark, rows, "model string, term string, estimate double, se double, mde double, n long, r2 double")


def fit_sql(rows: str, xs: dict[str, str], y: str, one: str = "1.0") -> str:
    """CTEs of a least squares fit over rows: rest has the columns of rows, r0, r1, ... (what the others leave
    of each regressor, the constant first) and e, the residual. Coefficients are sum(r y) / sum(r r)."""
    p = len(xs) + 1
    ctes = [f"d0 AS (SELECT *, ({one})::DOUBLE AS z0, {', '.join(f'({x})::DOUBLE AS z{k}' for k, x in enumerate(xs.values(), 1))}, ({y})::DOUBLE AS y FROM {rows})"]
    off = lambda z, us: z + "".join(f" - sum({z} * {u}) OVER () / sum({u} * {u}) OVER () * {u}" for u in us)
    name = lambda k, j: f"z{[i for i in range(p) if i != k][0]}" if j == 0 else f"u{k}_{j}"
    for j in range(1, p):
        cols = []
        for k in range(p):
            others = [i for i in range(p) if i != k]
            done = [name(k, i) for i in range(j)]
            cols.append(f"{off(f'z{k}', done)} AS r{k}" if j == p - 1 else f"{off(f'z{others[j]}', done)} AS u{k}_{j}")
        ctes.append(f"d{j} AS (SELECT *, {', '.join(cols)} FROM d{j - 1})")
    fitted = " + ".join(f"sum(r{k} * y) OVER () / sum(r{k} * r{k}) OVER () * z{k}" for k in range(p))
    return ", ".join([*ctes, f"rest AS (SELECT *, y - ({fitted}) AS e FROM d{p - 1})"])


def ols_sql(model: str, rows: str, xs: dict[str, str], y: str, cluster: str | None = None, one: str = "1.0", skip: tuple[str, ...] = (), before: str = TURNS) -> str:
    p, names = len(xs) + 1, ["intercept", *xs]
    ks = [k for k in range(p) if names[k] not in skip]
    whole = ", ".join(f"sum(r{k} * y) / sum(r{k} * r{k}) AS b{k}, sum(r{k} * r{k}) AS q{k}" + ("" if cluster else f", sum(r{k} * r{k} * e * e) AS v{k}") for k in range(p))
    factor = f"groups / (groups - 1.0) * (n - 1.0) / (n - {p})" if cluster else f"n / (n - {p}.0)"
    meat = f"k AS (SELECT {', '.join(f'sum(s * s) FILTER (WHERE k = {k}) AS v{k}' for k in range(p))}, count(DISTINCT g) AS groups FROM ({' UNION ALL '.join(f'SELECT {cluster} AS g, {k} AS k, sum(r{k} * e) AS s FROM rest GROUP BY 1' for k in range(p))})), " if cluster else ""
    each = " UNION ALL ".join(f"SELECT '{model}' AS model, '{names[k]}' AS term, round(b{k}, 3) AS estimate, round(sqrt({factor} * v{k}) / q{k}, 3) AS se, round({S.DETECTABLE} * sqrt({factor} * v{k}) / q{k}, 3) AS mde, n, round(r2, 6) AS r2 FROM {'a, k' if cluster else 'a'}" for k in ks)
    return f"WITH {before}, {fit_sql(rows, xs, y, one)}, a AS (SELECT count(*) AS n, 1 - sum(e * e) / (sum(y * y) - power(sum(z0 * y), 2) / sum(z0 * z0)) AS r2, {whole} FROM rest), {meat}z AS ({each}) SELECT * FROM z"


@query("stat_icc1", f"WITH {TURNS}, {MOM}, {ICC} SELECT grp, round(k0, 6) AS k0, (msb - msw) / (msb + (k0 - 1) * msw) < 0 AS clamped, round(greatest((msb - msw) / (msb + (k0 - 1) * msw), 0), 6) AS icc FROM i")
def stat_icc1(spark: SparkSession, d: str) -> DataFrame:
    return S.icc1(moments(spark, d), ["grp"]).select("grp", R("k0").alias("k0"), "clamped", R("icc").alias("icc"))


@query("stat_split_half", f"WITH {TURNS}, {HALF}, p AS (SELECT player, avg(price) FILTER (WHERE odd = 1) AS a, avg(price) FILTER (WHERE odd = 0) AS b, least(count(*) FILTER (WHERE odd = 1), count(*) FILTER (WHERE odd = 0)) AS m FROM half GROUP BY 1 HAVING m >= 3) SELECT round(corr(a, b), 6) AS r, round(2 * corr(a, b) / (1 + corr(a, b)), 6) AS spearman_brown, count(*) AS players, min(m) AS least_half FROM p")
def stat_split_half(spark: SparkSession, d: str) -> DataFrame:
    p = halves(turns(spark, d)).groupBy("player").agg(F.avg(F.when(c("odd") == 1, c("price"))).alias("a"), F.avg(F.when(c("odd") == 0, c("price"))).alias("b"), F.least(F.count_if(c("odd") == 1), F.count_if(c("odd") == 0)).alias("m")).where("m >= 3")
    r = F.corr("a", "b")
    return p.agg(R(r).alias("r"), R(2 * r / (1 + r)).alias("spearman_brown"), F.count("*").alias("players"), F.min("m").alias("least_half"))


@query("stat_season_corr", f"WITH {TURNS}, s AS (SELECT player, season, avg(price) AS mean FROM t GROUP BY 1, 2 HAVING count(*) >= 20) SELECT round(corr(a.mean, b.mean), 6) AS r, count(*) AS n FROM s a JOIN s b ON a.player = b.player AND b.season = a.season + 1")
def stat_season_corr(spark: SparkSession, d: str) -> DataFrame:
    s = turns(spark, d).groupBy("player", "season").agg(F.avg("price").alias("mean"), F.count("*").alias("n")).where("n >= 20")
    b = s.select("player", (c("season") - 1).alias("season"), c("mean").alias("later"))
    return s.join(b, ["player", "season"]).agg(R(F.corr("mean", "later")).alias("r"), F.count("*").alias("n"))


@query("stat_eta_squared", f"WITH {TURNS}, {MOM}, a AS (SELECT grp, sum(n) AS n, sum(n * mean) AS nm, sum(n * mean * mean) AS nm2, sum(ss) AS ssw FROM m GROUP BY 1) SELECT grp, round((nm2 - nm * nm / n) / (nm2 - nm * nm / n + ssw), 6) AS eta2 FROM a")
def stat_eta_squared(spark: SparkSession, d: str) -> DataFrame:
    n, m = c("n"), c("mean")
    a = moments(spark, d).groupBy("grp").agg((F.sum(n * m * m) - F.pow(F.sum(n * m), 2) / F.sum(n)).alias("ssb"), F.sum("ss").alias("ssw"))
    return a.select("grp", R(c("ssb") / (c("ssb") + c("ssw"))).alias("eta2"))


@query("stat_reliability_of_mean", f"WITH {TURNS}, {MOM}, {ICC}, r AS (SELECT grp, greatest((msb - msw) / (msb + (k0 - 1) * msw), 0) AS rho, msw FROM i) SELECT m.grp, player, round(n * rho / (1 + (n - 1) * rho), 6) AS reliability, round(sqrt(n * rho / (1 + (n - 1) * rho)), 6) AS attenuation, round(sqrt(msw / n), 4) AS se FROM m JOIN r ON m.grp = r.grp")
def stat_reliability_of_mean(spark: SparkSession, d: str) -> DataFrame:
    m = moments(spark, d)
    j = m.join(F.broadcast(S.icc1(m, ["grp"])), "grp")
    return j.select("grp", "player", R(c("n") * c("icc") / (1 + (c("n") - 1) * c("icc"))).alias("reliability"), R(F.sqrt(c("n") * c("icc") / (1 + (c("n") - 1) * c("icc")))).alias("attenuation"), R(F.sqrt(c("msw") / c("n")), 4).alias("se"))


@query("stat_adjusted_icc", f"WITH {TURNS}, {fit_sql('t', {'a': 'angle', 'a2': 'angle * angle', 'v': 'value', 'v2': 'value * value'}, 'price')}, m AS (SELECT grp, player, count(*) AS n, avg(e) AS mean, var_pop(e) * count(*) AS ss FROM rest GROUP BY 1, 2), {ICC} SELECT grp, round(greatest((msb - msw) / (msb + (k0 - 1) * msw), 0), 6) AS icc, round(msw, 2) AS msw FROM i")
def stat_adjusted_icc(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).withColumn("angle2", c("angle") * c("angle")).withColumn("value2", c("value") * c("value"))
    xs = ["angle", "angle2", "value", "value2"]
    beta = S.solve(*S.unpack(S.gram(t, xs, "price").first(), 5)[:2])
    rest = t.withColumn("rest", c("price") - S.linear(xs, beta))
    return S.icc1(S.group_moments(rest, ["grp", "player"], "rest"), ["grp"]).select("grp", R("icc").alias("icc"), R("msw", 2).alias("msw"))


@query("stat_two_way_icc", f"WITH {TURNS}, y AS (SELECT player, season, avg(price) AS v FROM t GROUP BY 1, 2), h AS (SELECT count(DISTINCT season) AS h FROM y), k AS (SELECT * FROM y, h WHERE player IN (SELECT player FROM y, h GROUP BY player, h HAVING count(*) = h)), w AS (SELECT *, avg(v) OVER (PARTITION BY player) AS r, avg(v) OVER (PARTITION BY season) AS s, avg(v) OVER () AS g FROM k), q AS (SELECT any_value(h) AS h, count(DISTINCT player) AS n, sum(power(r - g, 2)) / (count(DISTINCT player) - 1) AS msr, sum(power(s - g, 2)) / (any_value(h) - 1) AS msc, sum(power(v - r - s + g, 2)) / ((count(DISTINCT player) - 1) * (any_value(h) - 1)) AS mse FROM w) SELECT n, h AS seasons, round((msr - mse) / (msr + (h - 1) * mse + h * (msc - mse) / n), 6) AS icc21 FROM q")
def stat_two_way_icc(spark: SparkSession, d: str) -> DataFrame:
    """ICC(2,1) of the players that have a mean in every season."""
    y = turns(spark, d).groupBy("player", "season").agg(F.avg("price").alias("v"))
    k = y.crossJoin(F.broadcast(y.agg(F.countDistinct("season").alias("seasons")))).withColumn("full", F.count("*").over(Window.partitionBy("player"))).where("full = seasons")
    r, s, g = k.groupBy("player").agg(F.avg("v").alias("r")), k.groupBy("season").agg(F.avg("v").alias("s")), k.agg(F.avg("v").alias("g"))
    w = k.join(r, "player").join(F.broadcast(s), "season").crossJoin(F.broadcast(g))
    q = w.agg(F.countDistinct("player").alias("n"), F.max("seasons").alias("seasons"), F.sum(F.pow(c("r") - c("g"), 2)).alias("a"), F.sum(F.pow(c("s") - c("g"), 2)).alias("b"), F.sum(F.pow(c("v") - c("r") - c("s") + c("g"), 2)).alias("e"))
    h = c("seasons")
    q = q.withColumn("msr", c("a") / (c("n") - 1)).withColumn("msc", c("b") / (h - 1)).withColumn("mse", c("e") / ((c("n") - 1) * (h - 1)))
    return q.select("n", "seasons", R((c("msr") - c("mse")) / (c("msr") + (h - 1) * c("mse") + h * (c("msc") - c("mse")) / c("n"))).alias("icc21"))


@query("stat_nested_variance", f"WITH {TURNS}, a AS (SELECT player, play, count(*) AS n, avg(price) AS mean, var_pop(price) * count(*) AS ss FROM t GROUP BY 1, 2), b AS (SELECT player, count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS mean, sum(ss) AS ssw, sum(n * mean * mean) - power(sum(n * mean), 2) / sum(n) AS ssg FROM a GROUP BY 1) SELECT round(sum(ssw) / (sum(n) - sum(k)), 2) AS within, round(sum(ssg) / (sum(k) - count(*)), 2) AS between_plays, round((sum(n * mean * mean) - power(sum(n * mean), 2) / sum(n)) / (count(*) - 1), 2) AS between_players FROM b")
def stat_nested_variance(spark: SparkSession, d: str) -> DataFrame:
    a = moments(spark, d, ("player", "play"))
    n, m = c("n"), c("mean")
    b = a.groupBy("player").agg(F.count("*").alias("k"), F.sum(n).alias("N"), (F.sum(n * m) / F.sum(n)).alias("M"), F.sum("ss").alias("ssw"), (F.sum(n * m * m) - F.pow(F.sum(n * m), 2) / F.sum(n)).alias("ssg"))
    N, M = c("N"), c("M")
    return b.agg(R(F.sum("ssw") / (F.sum(N) - F.sum("k")), 2).alias("within"), R(F.sum("ssg") / (F.sum("k") - F.count("*")), 2).alias("between_plays"), R((F.sum(N * M * M) - F.pow(F.sum(N * M), 2) / F.sum(N)) / (F.count("*") - 1), 2).alias("between_players"))


@query("stat_eb_shrinkage", f"WITH {TURNS}, {MOM}, v AS (SELECT grp, sum(ss) / (sum(n) - count(*)) AS s2, sum(n * mean) / sum(n) AS mu, greatest(var_samp(mean) - avg(1.0 / n) * (sum(ss) / (sum(n) - count(*))), 0) AS t2 FROM m GROUP BY 1) SELECT m.grp, player, round(mu + (mean - mu) * t2 / (t2 + s2 / n), 3) AS posterior, round(sqrt(t2 * (s2 / n) / (t2 + s2 / n)), 3) AS sd FROM m JOIN v ON m.grp = v.grp")
def stat_eb_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    m = moments(spark, d)
    s2 = F.sum("ss") / (F.sum("n") - F.count("*"))
    v = m.groupBy("grp").agg(s2.alias("s2"), (F.sum(c("n") * c("mean")) / F.sum("n")).alias("mu"), F.greatest(F.var_samp("mean") - F.avg(1.0 / c("n")) * s2, F.lit(0.0)).alias("t2"))
    return m.join(F.broadcast(v), "grp").select("grp", "player", R(c("mu") + (c("mean") - c("mu")) * c("t2") / (c("t2") + c("s2") / c("n")), 3).alias("posterior"), R(F.sqrt(c("t2") * (c("s2") / c("n")) / (c("t2") + c("s2") / c("n"))), 3).alias("sd"))


@query("stat_moment_tau2", f"WITH {TURNS}, p AS (SELECT grp, player, quantile_cont(price, 0.9) AS q, (quantile_cont(price, 0.95) - quantile_cont(price, 0.85)) / 0.1 AS slope, count(*) AS n FROM t GROUP BY 1, 2), a AS (SELECT grp, var_samp(q) AS v, avg(0.9 * 0.1 / n * slope * slope) AS noise FROM p GROUP BY 1) SELECT grp, round(greatest(v - noise, 0), 1) AS tau2, round(noise, 1) AS noise, CASE WHEN v > noise THEN 'positive' ELSE 'zero' END AS status FROM a")
def stat_moment_tau2(spark: SparkSession, d: str) -> DataFrame:
    """Variance of the players' quantiles beyond their own errors: a quantile's is q (1 - q) / n over the
    squared density, which the quantiles beside it give."""
    p = turns(spark, d).groupBy("grp", "player").agg(F.percentile("price", F.array(*map(F.lit, (0.85, 0.9, 0.95)))).alias("q"), F.count("*").alias("n"))
    slope = (c("q")[2] - c("q")[0]) / 0.1
    a = p.groupBy("grp").agg(F.var_samp(c("q")[1]).alias("v"), F.avg(0.9 * 0.1 / c("n") * slope * slope).alias("noise"))
    return a.select("grp", R(F.greatest(c("v") - c("noise"), F.lit(0.0)), 1).alias("tau2"), R("noise", 1).alias("noise"), F.when(c("v") > c("noise"), "positive").otherwise("zero").alias("status"))


def draws_sql(kind: str, reps: int = REPS) -> str:
    """CTE w of (rep, player, w) over the players of m."""
    return f"w AS ({B.weights_sql('(SELECT DISTINCT player FROM m)', 'player', reps, SEED, kind)})"


BOOT_SUMS = ["j", "n", "nn", "nm", "nmm", "ss", "hits"]
BOOT_STATS = {
    "mean": "CASE WHEN n > 0 THEN nm / n END",
    "proportion": "CASE WHEN n > 0 THEN hits / n END",
    "icc": "CASE WHEN j > 1 AND n > j THEN greatest(0.0, ((nmm - nm * nm / n) / (j - 1) - ss / (n - j)) / ((nmm - nm * nm / n) / (j - 1) + ((n - nn / n) / (j - 1) - 1) * ss / (n - j))) END",
    "eta2": "CASE WHEN n > 0 THEN (nmm - nm * nm / n) / nullif(nmm - nm * nm / n + ss, 0) END",
}
BOOT_SQL = f"""WITH {TURNS}, p AS (SELECT player, count(*)::DOUBLE AS n, avg(price) AS mean, var_pop(price) * count(*) AS ss, count(*) FILTER (WHERE value > 0.05) AS hits FROM t GROUP BY 1),
 m AS (SELECT player, 1.0::DOUBLE AS j, n, n * n AS nn, n * mean AS nm, n * mean * mean AS nmm, ss, hits::DOUBLE AS hits FROM p), {draws_sql("poisson")},
 v AS (SELECT rep, player, w FROM w UNION ALL SELECT -1, player, 1 FROM m),
 s AS (SELECT rep, {", ".join(f"sum(w * {k}) AS {k}" for k in BOOT_SUMS)} FROM m JOIN v USING (player) GROUP BY 1),
 a AS (SELECT rep, angle, sum(w * n) AS n FROM (SELECT player, angle, count(*) AS n FROM t GROUP BY 1, 2) JOIN v USING (player) GROUP BY 1, 2),
 u AS (SELECT rep, angle, sum(n) OVER (PARTITION BY rep ORDER BY angle) AS upto, sum(n) OVER (PARTITION BY rep) AS total FROM a WHERE n > 0),
 g AS (SELECT rep, cell, sum(w * n) AS n FROM (SELECT player, floor(angle / 10)::BIGINT AS cell, count(*) AS n FROM t GROUP BY 1, 2) JOIN v USING (player) GROUP BY 1, 2),
 x AS ({" UNION ALL ".join(f"SELECT rep, '{k}' AS statistic, NULL::BIGINT AS cell, {e} AS x FROM s" for k, e in BOOT_STATS.items())}
  UNION ALL SELECT rep, 'median', NULL, (min(angle) FILTER (WHERE upto > floor((total - 1) / 2)) + min(angle) FILTER (WHERE upto > ceil((total - 1) / 2))) / 2 FROM u GROUP BY 1
  UNION ALL SELECT rep, 'share', cell, g.n / nullif(s.n, 0) FROM g JOIN s USING (rep))
 SELECT statistic, cell, count(*) FILTER (WHERE rep >= 0) AS reps, round(max(x) FILTER (WHERE rep < 0), 6) AS point, round(quantile_cont(x, 0.025) FILTER (WHERE rep >= 0), 6) AS lo, round(quantile_cont(x, 0.975) FILTER (WHERE rep >= 0), 6) AS hi FROM x GROUP BY 1, 2"""


@query("stat_cluster_bootstrap", BOOT_SQL)
def stat_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals over replicates that draw players with all their rows: mean, proportion, ICC and share of between-player
    variance of the outcome, the median angle, and each angle cell's share of rows."""
    t = turns(spark, d)
    m = S.settled(t.groupBy("player").agg(F.count("*").cast("double").alias("n"), F.avg("price").alias("mean"), (F.var_pop("price") * F.count("*")).alias("ss"), F.count_if(c("value") > 0.05).alias("hits")))
    m = m.select("player", F.lit(1.0).alias("j"), "n", (c("n") * c("n")).alias("nn"), (c("n") * c("mean")).alias("nm"), (c("n") * c("mean") * c("mean")).alias("nmm"), "ss", "hits")
    drawn = S.settled(B.replicate_sums(m, "player", BOOT_SUMS, REPS, SEED))
    whole = m.agg(*[F.sum(k).alias(k) for k in BOOT_SUMS]).withColumn("rep", F.lit(-1)).select("rep", *BOOT_SUMS)
    sums = drawn.select("rep", *BOOT_SUMS).union(whole)
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), F.lit(None).cast("long").alias("cell"), F.expr(e).alias("x")) for k, e in BOOT_STATS.items()]))
    out = sums.select("rep", named.alias("v")).select("rep", "v.*")
    medians = B.replicate_quantile(t, "player", "angle", 0.5, REPS, SEED)
    middle = table_of(spark, [(k, float(x)) for k, x in enumerate(medians) if x == x], "rep int, x double").union(t.agg(F.lit(-1), F.median("angle")))
    out = out.union(middle.select("rep", F.lit("median"), F.lit(None).cast("long"), "x"))
    g = cells(t).where("cell >= 0").groupBy("player", "cell").agg(F.count("*").alias("n"))
    top = g.agg(F.max("cell")).first()[0]
    if top is not None:
        shares = B.replicate_sums(g, "player", ["n"], REPS, SEED, by="cell", groups=top + 1).select("rep", c("cell").cast("long").alias("cell"), "n").union(g.groupBy("cell").agg(F.sum("n").cast("double").alias("n")).select(F.lit(-1), "cell", "n"))
        out = out.union(shares.join(F.broadcast(sums.select("rep", c("n").alias("all"))), "rep").select("rep", F.lit("share"), "cell", F.try_divide("n", "all")))
    q = F.percentile(F.when(c("rep") >= 0, c("x")), F.array(F.lit(0.025), F.lit(0.975)))
    return out.groupBy("statistic", "cell").agg(F.count_if(c("rep") >= 0).alias("reps"), R(F.max(F.when(c("rep") < 0, c("x")))).alias("point"), q.alias("q")).select("statistic", "cell", "reps", "point", R(c("q")[0]).alias("lo"), R(c("q")[1]).alias("hi"))


@query("stat_bayes_bootstrap_weights", f"WITH {TURNS}, m AS (SELECT player, count(*) AS n, sum(price) AS s FROM t GROUP BY 1), {draws_sql('exponential')} SELECT rep::INTEGER AS rep, round(sum(w * s) / sum(w * n), 4) AS mean, round(avg(w), 6) AS mean_weight FROM m JOIN w USING (player) GROUP BY 1")
def stat_bayes_bootstrap_weights(spark: SparkSession, d: str) -> DataFrame:
    m = turns(spark, d).groupBy("player").agg(F.lit(1).alias("j"), F.count("*").alias("n"), F.sum("price").alias("s"))
    return B.replicate_sums(m, "player", ["j", "n", "s"], REPS, SEED, "exponential").crossJoin(m.agg(F.count("*").alias("players"))).select("rep", R(c("s") / c("n"), 4).alias("mean"), R(c("j") / c("players")).alias("mean_weight"))


@query("stat_bernoulli_draws")
def stat_bernoulli_draws(spark: SparkSession, d: str) -> DataFrame:
    g = cells(turns(spark, d)).groupBy("grp", "cell").agg(F.sum("price").alias("w"), F.avg((c("value") > 0.05).cast("double")).alias("p"))
    g = g.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("hit", (hash_uniform(SEED, "rep", "grp", "cell") < c("p")).cast("double"))
    r = g.groupBy("grp", "rep").agg((F.sum(c("w") * c("hit")) / F.sum("w")).alias("share"))
    q = F.percentile("share", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return r.groupBy("grp").agg(q.alias("q")).select("grp", R(c("q")[0]).alias("lo"), R(c("q")[1]).alias("mid"), R(c("q")[2]).alias("hi"))


PERMUTATIONS = 49


@query("stat_block_permutation")
def stat_block_permutation(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).select("play", "line", "player", "part", "value", "price")
    r = S.block_permutations(t, "player", ["play", "line", "player", "part"], "value", "price", PERMUTATIONS, SEED)
    seen = F.max(F.when(c("rep") == 0, F.abs("r")))
    wide = r.crossJoin(F.broadcast(r.agg(seen.alias("seen"), F.max(F.when(c("rep") == 0, c("r"))).alias("estimate"))))
    return wide.groupBy("estimate").agg(R((F.count_if((c("rep") > 0) & (F.abs("r") >= c("seen"))) + 1) / (PERMUTATIONS + 1)).alias("p")).select(R("estimate", 9).alias("estimate"), "p")


X = ["angle", "value", "tax"]
OLS = {x: x for x in X} | {"setting_f": "CASE WHEN setting = 'F' THEN 1 ELSE 0 END"}
ROOT = "sqrt(1 + 10 * tax)"
MEANS = "f AS (SELECT player, " + ", ".join(f"{k} - avg({k}) OVER (PARTITION BY player) AS {k}" for k in [*X, "price"]) + " FROM t)"
plain = {x: x for x in X}


@query("stat_ols", f"SELECT * FROM ({ols_sql('ols', 't', OLS, 'price')}) UNION ALL SELECT * FROM ({ols_sql('wls', 't', {k: f'{ROOT} * {x}' for k, x in OLS.items()}, f'{ROOT} * price', one=ROOT)})")
def stat_ols(spark: SparkSession, d: str) -> DataFrame:
    """With a dummy for the setting; plain and weighted."""
    t = turns(spark, d).withColumn("setting_f", (c("setting") == "F").cast("double")).withColumn("w", 1 + 10 * c("tax"))
    return coefficients(spark, S.ols(t, list(OLS), "price")).union(coefficients(spark, S.ols(t, list(OLS), "price", weight="w"), "wls"))


@query("stat_cluster_ols", f"SELECT * FROM ({ols_sql('pooled', 't', plain, 'price', 'player')}) UNION ALL SELECT * FROM ({ols_sql('fixed', 'f', plain, 'price', 'player', skip=('intercept',), before=f'{TURNS}, {MEANS}')})")
def stat_cluster_ols(spark: SparkSession, d: str) -> DataFrame:
    """Pooled, and with a fixed effect of each player."""
    t = turns(spark, d)
    return coefficients(spark, S.ols(t, X, "price", "player"), "pooled").union(coefficients(spark, S.ols(within(t, [*X, "price"]), X, "price", "player"), "fixed", ("intercept",)))


WILD_REPS = 1999
WILD_SQL = f"""WITH {TURNS}, f AS (WITH {fit_sql("t", plain, "price")} SELECT * FROM rest), b AS (SELECT sum(r2 * y) / sum(r2 * r2) AS b, count(*) AS n, {", ".join(f"sum(r{k} * r{k}) AS q{k}" for k in range(4))} FROM f),
 m AS (SELECT player, {", ".join(f"sum(r{k} * (e + b * r2)) / any_value(q{k}) AS d{k}, sum(r2 * z{k}) / any_value(q2) AS p{k}" for k in range(4))}, sum(r2 * e) / any_value(q2) AS u FROM f, b GROUP BY 1),
 o AS (SELECT sum(d2 * d2) AS qq, sum(u * u) AS uu, count(*) AS g, {", ".join(f"sum(p{j} * p{k}) AS x{j}{k}" for j in range(4) for k in range(4))} FROM m), {draws_sql("sign", WILD_REPS)},
 s AS (SELECT rep, {", ".join(f"sum(w * d{k}) AS s{k}, sum(w * d2 * p{k}) AS c{k}" for k in range(4))} FROM m JOIN w USING (player) GROUP BY 1),
 t2 AS (SELECT rep, s2, qq - 2 * ({" + ".join(f"s{k} * c{k}" for k in range(4))}) + {" + ".join(f"s{j} * x{j}{k} * s{k}" for j in range(4) for k in range(4))} AS v FROM s, o)
 SELECT 'value' AS term, round(b, 3) AS estimate, round(abs(b) / sqrt(g / (g - 1.0) * (n - 1.0) / (n - 4) * uu), 6) AS t, round((k + 1) / {WILD_REPS + 1}.0, 6) AS p, {WILD_REPS} AS reps, g AS clusters FROM b, o, (SELECT count(*) FILTER (WHERE abs(s2) / sqrt(v) >= abs(b) / sqrt(uu) * (1 - 1e-9)) AS k FROM t2, b, o)"""


@query("stat_wild_cluster", WILD_SQL)
def stat_wild_cluster(spark: SparkSession, d: str) -> DataFrame:
    w = B.wild_cluster(turns(spark, d), X, "price", "value", "player", WILD_REPS, SEED)
    return table_of(spark, [("value", round(w["estimate"], 3), round(w["t"], 6), round(w["p"], 6), w["reps"], w["clusters"])], "term string, estimate double, t double, p double, reps int, clusters long")


@query("stat_identified_set", f"WITH {TURNS}, e AS (SELECT play, avg(value) AS x, min(price) AS lo, max(price) AS hi, arg_min(price, (line, player, part)) AS first, arg_min(price, md5('{SEED}:' || play || ':' || line || ':' || player || ':' || part)) AS drawn FROM t GROUP BY 1), m AS (SELECT avg(x) AS mx, var_pop(x) AS vx, count(*) AS n FROM e), w AS (SELECT *, (x - mx) / (vx * n) AS w FROM e, m) SELECT round(sum(least(w * lo, w * hi)), 3) AS least, round(sum(greatest(w * lo, w * hi)), 3) AS largest, round(sum(w * first), 3) AS first, round(sum(w * drawn), 3) AS random FROM w")
def stat_identified_set(spark: SparkSession, d: str) -> DataFrame:
    """Least and largest slope on value over all choices of one outcome among each play's; the slopes of the
    pairing with the first line and of one drawn by a hash."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(SEED)), "play", "line", "player", "part"))
    e = turns(spark, d).groupBy("play").agg(F.avg("value").alias("x"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.min_by("price", F.struct("line", "player", "part")).alias("first"), F.min_by("price", drawn).alias("drawn"))
    m = e.agg(F.avg("x").alias("mx"), F.var_pop("x").alias("vx"), F.count("*").alias("n"))
    w = e.crossJoin(F.broadcast(m)).withColumn("w", (c("x") - c("mx")) / (c("vx") * c("n")))
    return w.agg(R(F.sum(F.least(c("w") * c("lo"), c("w") * c("hi"))), 3).alias("least"), R(F.sum(F.greatest(c("w") * c("lo"), c("w") * c("hi"))), 3).alias("largest"), R(F.sum(c("w") * c("first")), 3).alias("first"), R(F.sum(c("w") * c("drawn")), 3).alias("random"))


def slope_sums(t: DataFrame, ys: tuple[str, ...]) -> DataFrame:
    return t.groupBy("player").agg(F.count("*").alias("n"), F.sum("angle").alias("sx"), F.sum(c("angle") * c("angle")).alias("sxx"), *[F.sum(y).alias(f"s_{y}") for y in ys], *[F.sum(c("angle") * c(y)).alias(f"x_{y}") for y in ys])


def slopes(tot: DataFrame, ys: tuple[str, ...]) -> DataFrame:
    return tot.select("rep", *[F.try_divide(c("n") * c(f"x_{y}") - c("sx") * c(f"s_{y}"), c("n") * c("sxx") - c("sx") * c("sx")).alias(f"slope_{y}") for y in ys])


def replicate_slopes(spark: SparkSession, d: str, ys: tuple[str, ...]) -> DataFrame:
    sums = slope_sums(turns(spark, d), ys)
    return slopes(B.replicate_sums(sums, "player", sums.columns[1:], REPS, SEED), ys)


PAIRED = f"""WITH {TURNS}, m AS (SELECT player, count(*) AS n, sum(angle) AS sx, sum(angle * angle) AS sxx, sum(value) AS sv, sum(tax) AS st, sum(angle * value) AS xv, sum(angle * tax) AS xt FROM t GROUP BY 1), {draws_sql("poisson")},
 s AS (SELECT rep, {", ".join(f"sum(w * {k}) AS {k}" for k in ("n", "sx", "sxx", "sv", "st", "xv", "xt"))} FROM m JOIN (SELECT * FROM w UNION ALL SELECT -1, player, 1 FROM m) USING (player) GROUP BY 1), x AS (SELECT rep, ((n * xv - sx * sv) - (n * xt - sx * st)) / nullif(n * sxx - sx * sx, 0) AS delta FROM s)
 SELECT count(*) FILTER (WHERE rep >= 0) AS reps, round(max(delta) FILTER (WHERE rep < 0), 9) AS delta, round(quantile_cont(delta, 0.025) FILTER (WHERE rep >= 0), 9) AS lo, round(quantile_cont(delta, 0.975) FILTER (WHERE rep >= 0), 9) AS hi FROM x"""


@query("stat_paired_delta", PAIRED)
def stat_paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """The difference of two slopes on all rows, and its interval over replicates that draw the same players for both."""
    ys = ("value", "tax")
    sums = S.settled(slope_sums(turns(spark, d), ys))
    whole = slopes(sums.agg(F.lit(-1).alias("rep"), *[F.sum(k).alias(k) for k in sums.columns[1:]]), ys)
    x = slopes(B.replicate_sums(sums, "player", sums.columns[1:], REPS, SEED), ys).union(whole).select("rep", (c("slope_value") - c("slope_tax")).alias("delta"))
    q = F.percentile(F.when(c("rep") >= 0, c("delta")), F.array(F.lit(0.025), F.lit(0.975)))
    return x.agg(F.count_if(c("rep") >= 0).alias("reps"), R(F.max(F.when(c("rep") < 0, c("delta"))), 9).alias("delta"), R(q[0], 9).alias("lo"), R(q[1], 9).alias("hi"))


@query("stat_quantile_regression")
def stat_quantile_regression(spark: SparkSession, d: str) -> DataFrame:
    """The upper decile of price by angle with a random intercept per player: coefficients, then intercepts."""
    b, u = S.quantile_regression(turns(spark, d), ["angle"], "price", "player", 0.9, TAU2)
    fixed = table_of(spark, [("intercept", None, round(float(b[0]), 2)), ("angle", None, round(float(b[1]), 3))], "term string, player long, estimate double")
    return fixed.union(u.select(F.lit("player"), "player", R("u", 2)))


CELLS, TOLERANCE, REGION_REPS, LEAST_SHARE = [5.0, 15.0, 22.0, 25.0, 35.0, 45.0, 55.0], 34000.0, 200, 0.8
REGION_SQL = f"""WITH {TURNS}, m AS (SELECT player, count(*)::DOUBLE AS n, sum(angle) AS sx, sum(price) AS sy, sum(angle * angle) AS sxx, sum(angle * price) AS sxy, sum(price * price) AS syy FROM t GROUP BY 1), {draws_sql("exponential", REGION_REPS)},
 s AS (SELECT rep, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * sxy) AS sxy FROM m JOIN (SELECT * FROM w UNION ALL SELECT -1, player, 1 FROM m) USING (player) GROUP BY 1),
 b AS (SELECT rep, b1, (sy - b1 * sx) / n AS b0 FROM (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM s)), p AS (SELECT b0, b1 FROM b WHERE rep < 0),
 v AS (SELECT sum(n) AS n, count(*) AS j, sum(n * n) AS nn, sum(syy) - any_value(b0) * sum(sy) - any_value(b1) * sum(sxy) AS rss, sum(n * power(sy / n - b0 - b1 * sx / n, 2)) AS ssb FROM m, p),
 k AS (SELECT (rss - ssb) / (n - j) AS sigma2, greatest(0, (ssb / (j - 1) - (rss - ssb) / (n - j)) / ((n - nn / n) / (j - 1))) AS tau2 FROM v), e AS (SELECT player, sy / n AS y, sx / n AS x, tau2 / (tau2 + sigma2 / n) AS k FROM m, k),
 c AS (SELECT unnest({CELLS})::DOUBLE AS cell), f AS (SELECT player, cell, rep, k * y + (1 - k) * b0 + b1 * (cell - k * x) AS pred FROM e, c, b),
 o AS (SELECT player, cell, count(*) AS n FROM t JOIN c ON angle >= cell - 5 AND angle < cell + 5 GROUP BY 1, 2), z AS (SELECT cell, sum(n)::BIGINT AS n FROM o GROUP BY 1)
 SELECT f.player, f.cell, any_value(z.n) IS NOT NULL AS observed, round(max(pred) FILTER (WHERE rep < 0), 2) AS point, round(quantile_cont(pred, 0.05) FILTER (WHERE rep >= 0), 2) AS p05, round(quantile_cont(pred, 0.95) FILTER (WHERE rep >= 0), 2) AS p95, round(avg((pred >= {TOLERANCE})::INT) FILTER (WHERE rep >= 0), 6) AS inside_share,
  avg((pred >= {TOLERANCE})::INT) FILTER (WHERE rep >= 0) >= {LEAST_SHARE} AS inside, coalesce(any_value(z.n), 0) AS n_cell, coalesce(any_value(o.n), 0) AS n_player FROM f LEFT JOIN z ON f.cell = z.cell LEFT JOIN o ON f.cell = o.cell AND f.player = o.player GROUP BY 1, 2"""


@query("stat_feasible_region", REGION_SQL)
def stat_feasible_region(spark: SparkSession, d: str) -> DataFrame:
    """Each player's line on a grid: prediction, interval, and share of replicates that reach the tolerance.

    Lines come from cross products per player. A player's intercept is shrunk towards the pooled line by the share of
    between-player variance in what the line leaves, in each replicate (players weighted anew) by that replicate's line, so a prediction is
    linear in a replicate's two coefficients: the replicates are one small array and no row is repeated for them.
    """
    t = turns(spark, d)
    m = S.settled(S.gram(t, ["angle"], "price", ["player"]).select("player", *[c(k).alias(n) for k, n in zip(("g0_0", "g0_1", "g0_2", "g1_1", "g1_2", "g2_2"), ("n", "sx", "sy", "sxx", "sxy", "syy"), strict=True)]))
    sums = ["n", "sx", "sy", "sxx", "sxy"]
    slope = lambda r: (r["n"] * r["sxy"] - r["sx"] * r["sy"]) / (r["n"] * r["sxx"] - r["sx"] ** 2)
    line = lambda r: ((r["sy"] - slope(r) * r["sx"]) / r["n"], slope(r))
    total = m.agg(*[F.sum(k).alias(k) for k in [*sums, "syy"]], F.count("*").alias("j"), F.sum(c("n") * c("n")).alias("nn")).first()
    b0, b1 = line(total)
    ssb = m.agg(F.sum(c("n") * F.pow(c("sy") / c("n") - b0 - b1 * c("sx") / c("n"), 2))).first()[0]
    rss, n, j = total["syy"] - b0 * total["sy"] - b1 * total["sxy"], total["n"], total["j"]
    sigma2 = (rss - ssb) / (n - j)
    tau2 = max(0.0, (ssb / (j - 1) - sigma2) / ((n - total["nn"] / n) / (j - 1)))
    lines = F.array(*[F.struct(F.lit(float(x)).alias("b0"), F.lit(float(y)).alias("b1")) for x, y in map(line, B.replicate_sums(m, "player", sums, REGION_REPS, SEED, "exponential").orderBy("rep").collect())])
    e = m.select("player", (c("sy") / c("n")).alias("y"), (c("sx") / c("n")).alias("x"), (tau2 / (tau2 + sigma2 / c("n"))).alias("k"), F.explode(F.array(*map(F.lit, CELLS))).alias("cell"))
    pred = lambda x0, x1: c("k") * c("y") + (1 - c("k")) * x0 + x1 * (c("cell") - c("k") * c("x"))
    e = e.withColumn("point", pred(F.lit(b0), F.lit(b1))).withColumn("preds", F.sort_array(F.transform(lines, lambda r: pred(r["b0"], r["b1"]))))
    place = lambda q: q * (REGION_REPS - 1)
    at = lambda q: c("preds")[int(place(q))] + (c("preds")[math.ceil(place(q))] - c("preds")[int(place(q))]) * (place(q) - int(place(q)))
    share = F.size(F.filter("preds", lambda v: v >= TOLERANCE)) / REGION_REPS
    near = t.select("player", F.explode(F.filter(F.array(*map(F.lit, CELLS)), lambda v: (c("angle") >= v - 5) & (c("angle") < v + 5))).alias("cell")).groupBy("player", "cell").agg(F.count("*").alias("n_player"))
    out = e.join(near, ["player", "cell"], "left").join(F.broadcast(near.groupBy("cell").agg(F.sum("n_player").alias("n_cell"))), "cell", "left")  # a row a cell
    zero = lambda k: F.coalesce(c(k), F.lit(0).cast("long")).alias(k)
    return out.select("player", "cell", c("n_cell").isNotNull().alias("observed"), R("point", 2).alias("point"), R(at(0.05), 2).alias("p05"), R(at(0.95), 2).alias("p95"), R(share).alias("inside_share"), (share >= LEAST_SHARE).alias("inside"), zero("n_cell"), zero("n_player"))


@query("stat_heldout_loss")
def stat_heldout_loss(spark: SparkSession, d: str) -> DataFrame:
    """Quantile models of three sizes, fitted without a fold of players and scored on it by their own loss."""
    t = S.settled(turns(spark, d).select(*X, "price", F.pmod("player", F.lit(3)).alias("fold")))
    models = {f"{name}_{k}": (xs, c("fold") != k) for k in range(3) for name, xs in (("constant", []), ("angle", ["angle"]), ("all", X))}
    beta = S.quantile_fits(t, models, "price", 0.9)
    losses = t.agg(*[F.avg(F.when(~taught, S.pinball(c("price") - S.linear(xs, beta[n]), 0.9))).alias(n) for n, (xs, taught) in models.items()]).first()
    return table_of(spark, [(int(n[-1]), n[:-2], round(float(losses[n]), 2)) for n in models], "fold int, candidate string, loss double")


COLS = ["angle", "value", "tax", "price"]


def partial_sql(i: str, j: str, given: list[str]) -> str:
    """A partial correlation from those of one order less."""
    if not given:
        return f"r_{min(i, j)}_{max(i, j)}"
    k, rest = given[0], given[1:]
    ij, ik, jk = partial_sql(i, j, rest), partial_sql(i, k, rest), partial_sql(j, k, rest)
    return f"(({ij} - {ik} * {jk}) / sqrt((1 - {ik} * {ik}) * (1 - {jk} * {jk})))"


def matrix_sql() -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS k_{x}" for x in COLS)
    pairs = [(a, b) for n, a in enumerate(COLS) for b in COLS[n + 1 :]]
    corrs = ", ".join(f"corr({a}, {b}) AS r_{min(a, b)}_{max(a, b)}, corr(k_{a}, k_{b}) AS s_{a}_{b}" for a, b in pairs)
    out = []
    for a, b in pairs:
        rest = [x for x in COLS if x not in (a, b)]
        left = [f"(1 - power({partial_sql(a, x, seen)}, 2))" for x, seen in zip([b, *rest], ([], [b], [b, rest[0]]), strict=True)]
        out.append(f"SELECT '{a}' AS a, '{b}' AS b, round({partial_sql(a, b, [])}, 6) AS pearson, round(s_{a}_{b}, 6) AS spearman, round({partial_sql(a, b, rest)}, 6) AS partial, round(1 / ({' * '.join(left)}), 6) AS vif_a FROM c")
    return f"WITH {TURNS}, k AS (SELECT {', '.join(COLS)}, {ranks} FROM t), c AS (SELECT {corrs} FROM k) {' UNION ALL '.join(out)}"


@query("stat_correlation_matrix", matrix_sql())
def stat_correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs, t = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1 :]], turns(spark, d).select(*COLS)
    for x in COLS:
        t = S.average_ranks(t, x, f"k_{x}")
    r = t.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs], *[F.corr(f"k_{a}", f"k_{b}").alias(f"s_{a}_{b}") for a, b in pairs]).first()
    m = np.eye(4)
    for a, b in pairs:
        m[COLS.index(a), COLS.index(b)] = m[COLS.index(b), COLS.index(a)] = r[f"{a}_{b}"]
    inv = np.linalg.pinv(m)
    rows = [(a, b, round(float(m[i, j]), 6), round(float(r[f"s_{a}_{b}"]), 6), round(float(-inv[i, j] / math.sqrt(inv[i, i] * inv[j, j])), 6), round(float(inv[i, i]), 6)) for i, a in enumerate(COLS) for j, b in enumerate(COLS) if i < j]
    return table_of(spark, rows, "a string, b string, pearson double, spearman double, partial double, vif_a double")


@query("stat_aft_survival")
def stat_aft_survival(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).select("angle", "tax", (c("price") / 1000 + 0.001).alias("label"), (c("value") < 0.08).cast("double").alias("censor"))
    m = AFTSurvivalRegression(maxIter=20).fit(VectorAssembler(inputCols=["angle", "tax"], outputCol="features").transform(t))
    return table_of(spark, [("intercept", float(m.intercept)), ("angle", float(m.coefficients[0])), ("tax", float(m.coefficients[1])), ("scale", float(m.scale))], "term string, estimate double")


@query("stat_logistic")
def stat_logistic(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.log(c("n_chars") + 1).alias("size"), (c("lang") == "en").cast("double").alias("english"))
    t = docs.join(read(spark, d, "labels").select("doc_id", c("quality").cast("double").alias("label")), "doc_id")
    t = VectorAssembler(inputCols=["size", "english"], outputCol="features").transform(t)
    m = LogisticRegression(maxIter=30).fit(t)
    p = m.transform(t).select("label", vector_to_array("probability")[1].alias("p"))
    return p.agg(F.count("*").alias("n"), R(F.avg("p"), 4).alias("mean_p"), R(F.avg(F.when(c("label") == 1, 1 / c("p")).otherwise(1 / (1 - c("p")))), 3).alias("mean_ipw"))


def normal_cdf(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


@query("stat_two_one_sided")
def stat_two_one_sided(spark: SparkSession, d: str) -> DataFrame:
    f, margin = S.ols(turns(spark, d), X, "price", "player"), 5000.0
    b, se = float(f["beta"][2]), float(f["se"][2])
    p = max(1 - normal_cdf((b + margin) / se), normal_cdf((b - margin) / se))
    return table_of(spark, [("value", round(b, 4), round(p, 6), p < 0.05)], "term string, estimate double, p double, equivalent boolean")


@query("stat_wilson_interval", f"WITH {TURNS}, s AS (SELECT grp, count(*) AS n, avg(CASE WHEN angle >= 45 THEN 1.0 ELSE 0 END) AS p FROM t GROUP BY 1) SELECT grp, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS lo, round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS hi FROM s")
def stat_wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    s = turns(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.avg((c("angle") >= 45).cast("double")).alias("p"))
    z2, n, p = 1.96 * 1.96, c("n"), c("p")
    half = 1.96 * F.sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))
    return s.select("grp", R((p + z2 / (2 * n) - half) / (1 + z2 / n)).alias("lo"), R((p + z2 / (2 * n) + half) / (1 + z2 / n)).alias("hi"))


@query("stat_concordance")
def stat_concordance(spark: SparkSession, d: str) -> DataFrame:
    """Harrell's C over all pairs of rows; a pair counts where the earlier time is an event."""
    t = turns(spark, d).select((c("price") / 1000).alias("time"), c("angle").alias("risk"), (c("value") >= 0.03).alias("event"))
    return S.concordance(t, "time", "risk", "event").select("pairs", R(F.try_divide(c("higher") + 0.5 * c("tied"), c("pairs"))).alias("concordance"))


DOSES = {n: f"CASE WHEN angle >= {lo} AND angle < {hi} THEN 1 ELSE 0 END" for n, lo, hi in (("b15", 15, 30), ("b30", 30, 45), ("b45", 45, 1000))}
KNOTS = [0.05, 0.35, 0.65, 0.95]
CUBE = lambda k: f"power(greatest(angle - {k}, 0), 3)"
SPLINE = {"angle": "angle"} | {f"spline{j}": f"({CUBE(f'k{j}')} - {CUBE('k3')} * (k4 - k{j}) / (k4 - k3) + {CUBE('k4')} * (k3 - k{j}) / (k4 - k3)) / power(k4 - k1, 2)" for j in (1, 2)}
KNOTTED = f"{TURNS}, kn AS (SELECT {', '.join(f'quantile_cont(angle, {q}) AS k{j}' for j, q in enumerate(KNOTS, 1))} FROM t), ts AS (SELECT * FROM t, kn)"
NONLINEAR = f"""SELECT 'wald' AS model, 'nonlinear' AS term, round(w, 3) AS estimate, NULL::DOUBLE AS se, NULL::DOUBLE AS mde, n, NULL::DOUBLE AS r2, round(exp(-w / 2), 6) AS p FROM (SELECT n, (b2 * b2 * v33 - 2 * b2 * b3 * v23 + b3 * b3 * v22) / (v22 * v33 - v23 * v23) AS w FROM (
 WITH {KNOTTED}, {fit_sql("ts", SPLINE, "price")}, a AS (SELECT count(*) AS n, sum(r2 * y) / sum(r2 * r2) AS b2, sum(r3 * y) / sum(r3 * r3) AS b3, sum(r2 * r2) AS q2, sum(r3 * r3) AS q3 FROM rest), g AS (SELECT player, sum(r2 * e) AS s2, sum(r3 * e) AS s3 FROM rest GROUP BY 1)
 SELECT any_value(n) AS n, any_value(b2) AS b2, any_value(b3) AS b3, any_value(f) * sum(s2 * s2) / any_value(q2 * q2) AS v22, any_value(f) * sum(s3 * s3) / any_value(q3 * q3) AS v33, any_value(f) * sum(s2 * s3) / any_value(q2 * q3) AS v23 FROM g, a, (SELECT count(*) / (count(*) - 1.0) * (any_value(n) - 1.0) / (any_value(n) - 4.0) AS f FROM g, a)))"""


@query("stat_dose_bins", f"SELECT *, NULL::DOUBLE AS p FROM ({ols_sql('bins', 't', DOSES, 'price', 'player')}) UNION ALL SELECT *, NULL::DOUBLE FROM ({ols_sql('spline', 'ts', SPLINE, 'price', 'player', before=KNOTTED)}) UNION ALL {NONLINEAR}")
def stat_dose_bins(spark: SparkSession, d: str) -> DataFrame:
    """The outcome by bins of the angle and by a restricted cubic spline of it, with a joint test of the spline's
    nonlinear terms; errors by player."""
    t = turns(spark, d)
    t = t.withColumn("band", F.coalesce(band(t.angle, EDGES), F.lit("low"))).withColumns({n: (c("band") == v).cast("double") for n, v in zip(DOSES, ("15-30", "30-45", "45+"), strict=True)})
    knots = list(S.quantiles(t.withColumn("all", F.lit(1)), ["all"], "angle", KNOTS).select(*[f"q{k}" for k in range(len(KNOTS))]).first())
    basis = {f"spline{j}": e for j, e in enumerate(S.spline_basis(c("angle"), knots), 1)}
    fit = S.ols(t.withColumns(basis), ["angle", *basis], "price", "player")
    w, _, p = S.wald(fit, list(basis))
    test = table_of(spark, [("wald", "nonlinear", round(w, 3), None, None, fit["n"], None, round(p, 6))], "model string, term string, estimate double, se double, mde double, n long, r2 double, p double")
    each = coefficients(spark, S.ols(t, list(DOSES), "price", "player"), "bins").union(coefficients(spark, fit, "spline"))
    return each.withColumn("p", F.lit(None).cast("double")).union(test)


@query("stat_leave_one_out", f"WITH {TURNS}, m AS (SELECT player, count(*) AS n, sum(angle) AS sx, sum(price) AS sy, sum(angle * angle) AS sxx, sum(angle * price) AS sxy FROM t GROUP BY 1), o AS (SELECT sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy, sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy FROM m), b AS (SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM o) SELECT count(*) AS players, round(min(b), 6) AS least, round(max(b), 6) AS largest FROM b")
def stat_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    m = S.gram(turns(spark, d), ["angle"], "price", ["player"])
    ks = [k for k in m.columns if k != "player"]
    total = m.agg(*[F.sum(k).alias(f"t_{k}") for k in ks])
    w = m.crossJoin(F.broadcast(total)).select("player", *[(c(f"t_{k}") - c(k)).alias(k) for k in ks])
    slope = (c("g0_0") * c("g1_2") - c("g0_1") * c("g0_2")) / (c("g0_0") * c("g1_1") - c("g0_1") * c("g0_1"))
    return w.agg(F.count("*").alias("players"), R(F.min(slope), 6).alias("least"), R(F.max(slope), 6).alias("largest"))


@query("stat_spec_grid", f"WITH {TURNS}, s AS (SELECT 'all' AS spec, * FROM t UNION ALL SELECT 'angle10', * FROM t WHERE angle >= 10 UNION ALL SELECT 'angle25', * FROM t WHERE angle >= 25 UNION ALL SELECT 'taxed', * FROM t WHERE tax >= 0.04 UNION ALL SELECT 'setting_f', * FROM t WHERE setting = 'F') SELECT spec, count(*) AS n, round(regr_slope(price, value), 4) AS slope FROM s GROUP BY 1")
def stat_spec_grid(spark: SparkSession, d: str) -> DataFrame:
    specs = F.array_compact(F.array(F.lit("all"), F.when(c("angle") >= 10, "angle10"), F.when(c("angle") >= 25, "angle25"), F.when(c("tax") >= 0.04, "taxed"), F.when(c("setting") == "F", "setting_f")))
    m = S.gram(turns(spark, d).withColumn("spec", F.explode(specs)), ["value"], "price", ["spec"])
    slope = (c("g0_0") * c("g1_2") - c("g0_1") * c("g0_2")) / (c("g0_0") * c("g1_1") - c("g0_1") * c("g0_1"))
    return m.select("spec", c("g0_0").cast("long").alias("n"), R(slope, 4).alias("slope"))


def within(t: DataFrame, cols: list[str]) -> DataFrame:
    w = Window.partitionBy("player")
    return t.select("player", *[(c(k) - F.avg(k).over(w)).alias(k) for k in cols])


@query("stat_fwl_orthogonalise")
def stat_fwl_orthogonalise(spark: SparkSession, d: str) -> DataFrame:
    t = within(turns(spark, d), ["angle", "value", "tax", "price"])
    first = S.ols(t, ["tax", "angle"], "value")
    rest = t.withColumn("rest", c("value") - S.linear(["tax", "angle"], first["beta"]))
    second = S.ols(rest, ["rest"], "price", "player")
    return table_of(spark, [("value", round(float(second["beta"][1]), 4), round(float(second["se"][1]), 4), round(float(first["r2"]), 9))], "term string, estimate double, se double, first_r2 double")


@query("stat_placebo_outcome", ols_sql("ols", "t", plain, "part % 97", "player"))
def stat_placebo_outcome(spark: SparkSession, d: str) -> DataFrame:
    return coefficients(spark, S.ols(turns(spark, d).withColumn("placebo", (c("part") % 97).cast("double")), X, "placebo", "player"))


@query("stat_effective_n", f"WITH {TURNS}, r AS (SELECT grp, player, count(*) AS r FROM t GROUP BY 1, 2), {MOM}, a AS (SELECT grp, sum(n) AS n, sum(n * mean) AS nm, sum(n * mean * mean) AS nm2, sum(ss) AS ssw FROM m GROUP BY 1) SELECT r.grp, round(power(sum(r), 2) / sum(r * r), 6) AS effective, round(any_value((nm2 - nm * nm / n) / (nm2 - nm * nm / n + ssw)), 6) AS variance_share FROM r JOIN a ON r.grp = a.grp GROUP BY 1")
def stat_effective_n(spark: SparkSession, d: str) -> DataFrame:
    r = turns(spark, d).groupBy("grp", "player").agg(F.count("*").alias("r"))
    return r.groupBy("grp").agg(R(F.pow(F.sum("r"), 2) / F.sum(c("r") * c("r"))).alias("effective")).join(stat_eta_squared(spark, d).withColumnRenamed("eta2", "variance_share"), "grp")
