"""Queries of section 2.9: track kinematics on the frames of `events` (time in hours)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swerve.functions import columns as X
from swerve.operators import tracks as T
from swerve.sources.tables import FRAMES, frames, read

from .aggregating import STEP, R, steps
from .ordering import in_track, W
from .registry import query

c = F.col

# one frame per track and time: the first by id
ONE = f"{FRAMES}, o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY track, us ORDER BY id) = 1)"


def one(spark: SparkSession, d: str) -> DataFrame:
    w = in_track()
    return frames(spark, d).withColumn("_new", (F.row_number().over(w) == 1) | ~c("us").eqNullSafe(F.lag("us").over(w))).where("_new").drop("_new")


def grad_sql(v: str, t: str = "h") -> str:
    b, a = f"({t} - lag({t}) OVER w)", f"(lead({t}) OVER w - {t})"
    return f"(CASE WHEN lag({t}) OVER w IS NULL THEN (lead({v}) OVER w - {v}) / {a} WHEN lead({t}) OVER w IS NULL THEN ({v} - lag({v}) OVER w) / {b} ELSE ({b} * {b} * lead({v}) OVER w + ({a} * {a} - {b} * {b}) * {v} - {a} * {a} * lag({v}) OVER w) / ({a} * {b} * ({a} + {b})) END)"


@query("ts_gap_fill_linear", f"WITH {ONE}, p AS (SELECT *, lead(h) OVER w AS nh, lead(x) OVER w AS nx FROM o {W}), k AS (SELECT *, CASE WHEN nh - h <= 6 THEN greatest(CAST(round(nh - h) AS INTEGER), 1) ELSE 1 END AS k FROM p), r AS (SELECT *, unnest(range(0, k)) AS i FROM k) SELECT track, count(*) AS n, count(*) FILTER (WHERE i > 0) AS inserted, count(*) FILTER (WHERE i = 0 AND nh - h > 6) AS long_gaps, round(sum(CASE WHEN i = 0 THEN x ELSE x + (nx - x) * i / k END), 4) AS total FROM r GROUP BY 1")
def ts_gap_fill_linear(spark: SparkSession, d: str) -> DataFrame:
    f = T.fill_gaps(one(spark, d), ["track"], "h", ["x"], 1.0, 6.0)
    return f.groupBy("track").agg(F.count("*").alias("n"), F.count_if("inserted").alias("inserted"), F.sum("n_long").alias("long_gaps"), R(F.sum("x"), 4).alias("total"))


# the weights of a parabola through five even points, at each of its places
SAVGOL = "(CASE WHEN i = 1 THEN 31 * x + 9 * lead(x, 1) OVER w + -3 * lead(x, 2) OVER w + -5 * lead(x, 3) OVER w + 3 * lead(x, 4) OVER w WHEN i = 2 THEN 9 * lag(x, 1) OVER w + 13 * x + 12 * lead(x, 1) OVER w + 6 * lead(x, 2) OVER w + -5 * lead(x, 3) OVER w WHEN i = n THEN 31 * x + 9 * lag(x, 1) OVER w + -3 * lag(x, 2) OVER w + -5 * lag(x, 3) OVER w + 3 * lag(x, 4) OVER w WHEN i = n - 1 THEN 9 * lead(x, 1) OVER w + 13 * x + 12 * lag(x, 1) OVER w + 6 * lag(x, 2) OVER w + -5 * lag(x, 3) OVER w ELSE -3 * lag(x, 2) OVER w + 12 * lag(x, 1) OVER w + 17 * x + 12 * lead(x, 1) OVER w + -3 * lead(x, 2) OVER w END) / 35"


@query("ts_smooth_savgol", f"WITH {FRAMES}, s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY track) AS n FROM e {W}) SELECT track, id, round({SAVGOL}, 5) AS smooth FROM s {W}")
def ts_smooth_savgol(spark: SparkSession, d: str) -> DataFrame:
    return T.savgol(frames(spark, d), ["track"], ["us", "id"], "x", 5, 2).select("track", "id", R("smooth", 5).alias("smooth"))


@query("ts_smooth_kalman")
def ts_smooth_kalman(spark: SparkSession, d: str) -> DataFrame:
    return T.kalman(one(spark, d), ["track"], "h", "x", 0.5, 4.0).select("track", "h", R("smooth", 4).alias("smooth"), R("rate", 4).alias("rate"))


@query("ts_gradient", f"WITH {ONE} SELECT track, id, round({grad_sql('x')}, 4) AS rate FROM o {W}")
def ts_gradient(spark: SparkSession, d: str) -> DataFrame:
    return one(spark, d).select("track", "id", R(T.gradient(c("x"), c("h"), in_track()), 4).alias("rate"))


HEAD = f"{ONE}, q AS (SELECT *, {grad_sql('x')} AS vx, {grad_sql('y')} AS vy FROM o {W}), hd AS (SELECT *, (degrees(atan2(vx, vy)) + 360) % 360 AS heading, sqrt(vx * vx + vy * vy) AS speed FROM q)"


def headed(spark: SparkSession, d: str) -> DataFrame:
    return headed_from(one(spark, d))


def headed_from(rows: DataFrame, *more: str) -> DataFrame:
    """Rows with velocity, heading and speed in their track, of each value of the columns `more`."""
    w = in_track(*more)
    q = rows.withColumn("vx", T.gradient(c("x"), c("h"), w)).withColumn("vy", T.gradient(c("y"), c("h"), w))
    return q.withColumn("heading", X.heading(c("vx"), c("vy"))).withColumn("speed", F.sqrt(c("vx") * c("vx") + c("vy") * c("vy")))


UNWRAP = "u AS (SELECT *, coalesce(((heading - lag(heading) OVER w + 180) % 360 + 360) % 360 - 180, 0) AS dh FROM hd WINDOW w AS (PARTITION BY track ORDER BY us, id))"


def turned(spark: SparkSession, d: str) -> DataFrame:
    return turned_from(one(spark, d))


def turned_from(rows: DataFrame, *more: str) -> DataFrame:
    return headed_from(rows, *more).withColumn("dh", F.coalesce(X.wrap(c("heading") - F.lag("heading").over(in_track(*more))), F.lit(0.0)))


@query("ts_unwrap_rate", f"WITH {HEAD}, {UNWRAP} SELECT track, round(sum(dh), 3) AS net, round(sum(abs(dh)), 3) AS total FROM u GROUP BY 1")
def ts_unwrap_rate(spark: SparkSession, d: str) -> DataFrame:
    return turned(spark, d).groupBy("track").agg(R(F.sum("dh"), 3).alias("net"), R(F.sum(F.abs("dh")), 3).alias("total"))


@query("ts_hold_below_floor", f"WITH {HEAD} SELECT track, id, round(coalesce(last_value(CASE WHEN speed >= 5 THEN heading END IGNORE NULLS) OVER w, first_value(heading) OVER w), 4) AS held FROM hd WINDOW w AS (PARTITION BY track ORDER BY us, id ROWS UNBOUNDED PRECEDING)")
def ts_hold_below_floor(spark: SparkSession, d: str) -> DataFrame:
    return headed(spark, d).select("track", "id", R(T.hold_below(c("heading"), c("speed"), 5.0, in_track()), 4).alias("held"))


@query("ts_speed_qc_despike", f"WITH RECURSIVE {ONE}, n AS (SELECT track, us, h, x, y, row_number() OVER w AS i FROM o {W}), k AS (SELECT track, i, h, x, y, i AS kept FROM n WHERE i = 1 UNION ALL SELECT n.track, n.i, CASE WHEN ok THEN n.h ELSE k.h END, CASE WHEN ok THEN n.x ELSE k.x END, CASE WHEN ok THEN n.y ELSE k.y END, CASE WHEN ok THEN n.i ELSE k.kept END FROM k JOIN n ON n.track = k.track AND n.i = k.i + 1, LATERAL (SELECT sqrt(power(n.x - k.x, 2) + power(n.y - k.y, 2)) <= 20 * (n.h - k.h) AS ok)) SELECT track, count(DISTINCT kept) AS kept FROM k GROUP BY 1")
def ts_speed_qc_despike(spark: SparkSession, d: str) -> DataFrame:
    return T.despike(one(spark, d), ["track"], "h", "x", "y", 20.0).groupBy("track").agg(F.count("*").alias("kept"))


@query("ts_peak_effort", f"WITH {HEAD}, a AS (SELECT track, speed, {grad_sql('speed')} AS acc FROM hd {W}), p AS (SELECT track, max(speed) AS s, max(abs(acc)) AS a FROM a WHERE speed <= 200 GROUP BY 1) SELECT c_custkey AS player, c_mktsegment AS position, round(coalesce(s, 0), 3) AS peak_speed, round(coalesce(a, 0), 3) AS peak_acceleration FROM customer LEFT JOIN p ON c_custkey = track")
def ts_peak_effort(spark: SparkSession, d: str) -> DataFrame:
    a = headed(spark, d).withColumn("acc", T.gradient(c("speed"), c("h"), in_track())).where("speed <= 200")
    p = a.groupBy("track").agg(F.max("speed").alias("s"), F.max(F.abs("acc")).alias("a"))
    zero = lambda v: R(F.coalesce(v, F.lit(0.0)), 3)
    return read(spark, d, "customer").join(p, c("c_custkey") == c("track"), "left").select(c("c_custkey").alias("player"), c("c_mktsegment").alias("position"), zero("s").alias("peak_speed"), zero("a").alias("peak_acceleration"))


@query("ts_cut_features", f"WITH {HEAD}, {UNWRAP}, k AS (SELECT track, arg_max(us, (round(abs(dh), 6), -us)) AS cut FROM u GROUP BY 1) SELECT u.track, cut, round(max(speed) FILTER (WHERE us < cut), 3) AS entry, round(min(speed) FILTER (WHERE us > cut), 3) AS exit FROM u JOIN k ON u.track = k.track GROUP BY 1, 2")
def ts_cut_features(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("track")
    u = turned(spark, d).withColumn("cut", F.max_by("us", F.struct(F.round(F.abs("dh"), 6).alias("a"), (-c("us")).alias("b"))).over(w))
    return u.groupBy("track", "cut").agg(R(F.max(F.when(c("us") < c("cut"), c("speed"))), 3).alias("entry"), R(F.min(F.when(c("us") > c("cut"), c("speed"))), 3).alias("exit"))


PATH = f"{FRAMES}, {STEP}, pa AS (SELECT track, us, id, h - min(h) OVER (PARTITION BY track) AS r, sum(coalesce(step, 0)) OVER (PARTITION BY track ORDER BY us, id) AS path FROM s)"


def pathed(spark: SparkSession, d: str) -> DataFrame:
    s = steps(frames(spark, d))
    return s.withColumn("r", c("h") - F.min("h").over(Window.partitionBy("track"))).withColumn("path", F.sum(F.coalesce("step", F.lit(0.0))).over(in_track()))


SPLITS, TIMES = (200, 500, 2000), (24, 240)
STRAIGHT_SQL = f"""WITH {PATH}, v AS (SELECT *, lag(r) OVER w AS pr, lag(path) OVER w AS pp, (path - lag(path) OVER w) / nullif(r - lag(r) OVER w, 0) AS v FROM pa {W}), a AS (SELECT *, (v - lag(v) OVER w) / nullif(r - pr, 0) AS acc, max(v) OVER (PARTITION BY track) AS peak FROM v {W}), b AS (SELECT *, min(CASE WHEN v = peak THEN r END) OVER (PARTITION BY track) AS peak_r FROM a)
 SELECT track, round(max(path) FILTER (WHERE r <= 24), 4) AS day1, round(max(path) FILTER (WHERE r <= 240), 4) AS day10, round(max(peak), 3) AS peak_speed, {", ".join(f"round(min(pr + (r - pr) * ({x} - pp) / (path - pp)) FILTER (WHERE path >= {x} AND pp < {x}), 4) AS time_to_{x}, round(min(v) FILTER (WHERE path >= {x} AND pp < {x}), 3) AS speed_at_{x}" for x in SPLITS)},
 {", ".join(f"round(arg_max(v, (us, id)) FILTER (WHERE r <= {x} AND v IS NOT NULL), 3) AS speed_at_{x}h" for x in TIMES)}, round(-min(acc), 3) AS max_decel, round(min(v) FILTER (WHERE r >= peak_r), 3) AS least_after_peak, round(max(peak) - min(v) FILTER (WHERE r >= peak_r), 3) AS deficit_after_peak FROM b GROUP BY 1"""


@query("ts_straight_features", STRAIGHT_SQL)
def ts_straight_features(spark: SparkSession, d: str) -> DataFrame:
    """Distance by fixed times, times and speeds at fixed distances, speeds under way at fixed times, and what follows the fastest step."""
    w, whole = in_track(), Window.partitionBy("track")
    p = pathed(spark, d).withColumns({"pr": F.lag("r").over(w), "pp": F.lag("path").over(w)})
    p = p.withColumn("v", F.try_divide(c("path") - c("pp"), c("r") - c("pr")))
    p = p.withColumns({"acc": F.try_divide(c("v") - F.lag("v").over(w), c("r") - c("pr")), "peak": F.max("v").over(whole)}).withColumn("peak_r", F.min(F.when(c("v") == c("peak"), c("r"))).over(whole))
    aggs = [R(F.max(F.when(c("r") <= x, c("path"))), 4).alias(k) for k, x in (("day1", 24), ("day10", 240))] + [R(F.max("peak"), 3).alias("peak_speed")]
    for x in SPLITS:  # the path never falls, so one step holds each distance
        here = (c("path") >= x) & (c("pp") < x)
        aggs += [R(F.min(F.when(here, c("pr") + (c("r") - c("pr")) * (x - c("pp")) / (c("path") - c("pp")))), 4).alias(f"time_to_{x}"), R(F.min(F.when(here, c("v"))), 3).alias(f"speed_at_{x}")]
    for x in TIMES:
        seen = (c("r") <= x) & c("v").isNotNull()
        aggs.append(R(F.max_by(F.when(seen, c("v")), F.when(seen, F.struct("us", "id"))), 3).alias(f"speed_at_{x}h"))
    after = F.min(F.when(c("r") >= c("peak_r"), c("v")))
    return p.groupBy("track").agg(*aggs, R(-F.min("acc"), 3).alias("max_decel"), R(after, 3).alias("least_after_peak"), R(F.max("peak") - after, 3).alias("deficit_after_peak"))


@query("ts_crossing_time", f"WITH {PATH}, b AS (SELECT *, lag(r) OVER w AS pr, lag(path) OVER w AS pp FROM pa {W}), f AS (SELECT track, arg_min(struct_pack(r := r, path := path, pr := pr, pp := pp), (us, id)) AS f FROM b WHERE path >= 500 GROUP BY 1), g AS (SELECT track, CASE WHEN f.pr IS NULL THEN f.r ELSE f.pr + (f.r - f.pr) * (500 - f.pp) / (f.path - f.pp) END AS met, coalesce(f.r - f.pr, 0) AS gap FROM f), p AS (SELECT track, met, gap, CASE WHEN gap <= 12 THEN 'none' WHEN met <= 240 THEN 'forbidden' WHEN gap < 24 THEN 'bridged' ELSE 'too_long' END AS policy FROM g) SELECT a.track, p.track IS NOT NULL AS crossed, coalesce(policy IN ('none', 'bridged'), false) AS ok, round(CASE WHEN policy IN ('none', 'bridged') THEN met END, 4) AS crossed_at, round(gap, 4) AS gap, coalesce(policy, 'none') AS policy FROM (SELECT DISTINCT track FROM pa) a LEFT JOIN p ON a.track = p.track")
def ts_crossing_time(spark: SparkSession, d: str) -> DataFrame:
    x = T.crossing(pathed(spark, d), ["track"], ["us", "id"], "r", "path", 500.0, 12.0, 24.0, 240.0)
    return x.select("track", "crossed", "ok", R("crossed_at", 4).alias("crossed_at"), R("gap", 4).alias("gap"), "policy")


@query("ts_travel_axis", f"WITH {FRAMES}, m AS (SELECT track, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a, arg_max(x, (us, id)) - arg_min(x, (us, id)) AS dx, arg_max(y, (us, id)) - arg_min(y, (us, id)) AS dy FROM e GROUP BY 1), o AS (SELECT track, CASE WHEN dx * cos(a) + dy * sin(a) < 0 THEN a + pi() ELSE a END AS a, abs(dx * cos(a) + dy * sin(a)) AS along FROM m) SELECT o.track, round(degrees(any_value(a)), 4) AS axis, round(any_value(along), 4) AS along, round(max(x * cos(a) + y * sin(a)) - min(x * cos(a) + y * sin(a)), 4) AS extent FROM e JOIN o ON e.track = o.track GROUP BY 1")
def ts_travel_axis(spark: SparkSession, d: str) -> DataFrame:
    """Principal axis of a track, turned the way its end lies; end displacement and extent along it."""
    e, order = frames(spark, d), F.struct("us", "id")
    m = e.groupBy("track").agg((0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("a"), *[(F.max_by(v, order) - F.min_by(v, order)).alias(f"d{v}") for v in ("x", "y")])
    ahead = c("dx") * F.cos("a") + c("dy") * F.sin("a")
    o = m.select("track", F.when(ahead < 0, c("a") + math.pi).otherwise(c("a")).alias("a"), F.abs(ahead).alias("along"))
    on = c("x") * F.cos("a") + c("y") * F.sin("a")
    return e.join(o, "track").groupBy("track").agg(R(F.degrees(F.first("a")), 4).alias("axis"), R(F.first("along"), 4).alias("along"), R(F.max(on) - F.min(on), 4).alias("extent"))


@query("ts_power_integral", f"WITH {HEAD}, p AS (SELECT track, greatest(x * speed, 0) AS a, greatest(lead(x * speed) OVER w, 0) AS b, lead(h) OVER w - h AS dt FROM hd {W}) SELECT track, round(sum(CASE WHEN dt <= 12 THEN (a + b) / 2 * dt ELSE 0 END), 2) AS work FROM p GROUP BY 1")
def ts_power_integral(spark: SparkSession, d: str) -> DataFrame:
    p = headed(spark, d).withColumn("a", F.greatest(c("x") * c("speed"), F.lit(0.0)))
    p = p.withColumn("b", F.lead("a").over(in_track())).withColumn("dt", F.lead("h").over(in_track()) - c("h"))
    return p.groupBy("track").agg(R(F.sum(F.when(c("dt") <= 12, (c("a") + c("b")) / 2 * c("dt")).otherwise(0.0)), 2).alias("work"))


LAGS = range(-3, 4)
LAG_SQL = ", ".join(f"corr(x, y{k + 3}) AS c{k + 3}" for k in LAGS)


@query("ts_lag_of_max_xcorr", f"WITH {FRAMES}, l AS (SELECT track, x, {', '.join(f'lag(y, {k}) OVER w AS y{k + 3}' if k >= 0 else f'lead(y, {-k}) OVER w AS y{k + 3}' for k in LAGS)} FROM e {W}), k AS (SELECT track, {LAG_SQL} FROM l GROUP BY 1), u AS (UNPIVOT k ON c0, c1, c2, c3, c4, c5, c6 INTO NAME name VALUE r) SELECT track, arg_max(CAST(substr(name, 2) AS INTEGER) - 3, (round(r, 9), name)) AS best FROM u GROUP BY 1")
def ts_lag_of_max_xcorr(spark: SparkSession, d: str) -> DataFrame:
    l = frames(spark, d).select("track", "x", *[(F.lag("y", k) if k >= 0 else F.lead("y", -k)).over(in_track()).alias(f"y{k + 3}") for k in LAGS])  # noqa: E741
    k = l.groupBy("track").agg(F.array(*[F.struct(R(F.corr("x", f"y{k + 3}"), 9).alias("r"), F.lit(k).alias("k")) for k in LAGS]).alias("a"))
    return k.select("track", F.array_max("a")["k"].alias("best"))


TAUS = [20.0 * 1.25**k for k in range(16)]
#: Steps around the best constant of the round before: an eighth, then a sixty-fourth of a step of the grid.
FINER = [[1.25 ** (j / m) for j in range(-8, 9)] for m in (8, 64)]
LEAST_FRAMES = 5


def fit_sql(name: str, candidates: str) -> str:
    """CTE of (track, tau, vmax, sse, n, spread), the best of each track among candidates (track, tau)."""
    return f"{name} AS MATERIALIZED (SELECT track, arg_min(tau, sse) AS tau, arg_min(vb / bb, sse) AS vmax, min(sse) AS sse, any_value(n) AS n, any_value(spread) AS spread FROM (SELECT track, tau, sum(v * b) AS vb, sum(b * b) AS bb, sum(v * v) - sum(v * b) * sum(v * b) / sum(b * b) AS sse, count(*) AS n, var_pop(v) * count(*) AS spread FROM (SELECT pa.track, tau, path AS v, 1 - exp(-r / tau) AS b FROM pa JOIN ({candidates}) USING (track)) GROUP BY 1, 2) GROUP BY 1)"


FITS = ", ".join([
    f"pa AS MATERIALIZED (SELECT * FROM pb WHERE track IN (SELECT track FROM pb GROUP BY track HAVING count(*) >= {LEAST_FRAMES} AND max(r) > 0))", fit_sql("z0", f"SELECT DISTINCT track, tau FROM pa, (SELECT unnest({TAUS}) AS tau)"),
    *[fit_sql(f"z{k}", f"SELECT DISTINCT track, least({TAUS[-1]!r}::DOUBLE, greatest({TAUS[0]!r}::DOUBLE, tau * q)) AS tau FROM z{k - 1}, (SELECT unnest({f}) AS q)") for k, f in enumerate(FINER, 1)],
])


@query("ts_fit_exponential", f"WITH {PATH.replace('pa AS', 'pb AS')}, {FITS} SELECT track, z2.n IS NOT NULL AS found, round(tau, 3) AS tau, round(vmax, 2) AS vmax, round(sqrt(greatest(sse, 0) / n), 4) AS rmse, round(1 - sse / spread, 5) AS r2, coalesce(tau <= {TAUS[0]!r}::DOUBLE, false) AS at_lower, coalesce(tau >= {TAUS[-1]!r}::DOUBLE, false) AS at_upper FROM (SELECT DISTINCT track FROM pb) LEFT JOIN z2 USING (track)")
def ts_fit_exponential(spark: SparkSession, d: str) -> DataFrame:
    """The path as vmax (1 - exp(-t / tau)), with root mean square error, R2 and whether tau lies on a bound of its range."""
    f = T.fit_exponential(pathed(spark, d), ["track"], "r", "path", TAUS, FINER, LEAST_FRAMES)
    return f.select("track", "found", R("tau", 3).alias("tau"), R("vmax", 2).alias("vmax"), R("rmse", 4).alias("rmse"), R("r2", 5).alias("r2"), "at_lower", "at_upper")


BANDS = "CASE WHEN x >= 300 THEN 'fast' WHEN x >= 100 THEN 'mid' ELSE 'slow' END"
CROSS_SQL = f"""WITH {HEAD}, k AS (SELECT *, {grad_sql("speed")} AS accel, {grad_sql("x")} AS given_accel, {", ".join(f"{'lag' if k >= 0 else 'lead'}(speed, {abs(k)}) OVER w AS s{k + 3}" for k in LAGS)} FROM hd {W}),
 g AS (SELECT track, {", ".join(f"corr(x, s{k + 3}) AS c{k + 3}" for k in LAGS)} FROM k GROUP BY 1), u AS (UNPIVOT g ON {", ".join(f"c{k + 3}" for k in LAGS)} INTO NAME name VALUE r), l AS (SELECT track, arg_max(CAST(substr(name, 2) AS INTEGER) - 3, (round(r, 9), name)) AS lag FROM u GROUP BY 1),
 b AS (SELECT k.*, {BANDS} AS band, abs((y * 3.6 - heading + 540) % 360 - 180) AS turn FROM k), f AS (SELECT DISTINCT band, track FROM b), n AS (SELECT band, lag, count(*) AS n FROM f JOIN l USING (track) GROUP BY 1, 2), mo AS (SELECT band, arg_max(lag, (n, -lag)) AS lag FROM n GROUP BY 1)
 SELECT b.band, count(*) AS n, round(avg(speed - x), 3) AS speed_bias, round(avg(abs(speed - x)), 3) AS speed_mae, round(avg(abs(speed - x)) / greatest(avg(x), 1e-6), 6) AS speed_mae_share, round(avg(turn), 3) AS heading_mae, round(avg(accel - given_accel), 3) AS accel_bias, round(avg(abs(accel - given_accel)), 3) AS accel_mae, any_value(mo.lag) AS lag,
  round(avg(abs(CASE mo.lag {" ".join(f"WHEN {k} THEN s{k + 3}" for k in LAGS)} END - x)), 3) AS shifted_mae FROM b LEFT JOIN mo ON b.band = mo.band GROUP BY 1"""


@query("ts_kinematics_crosscheck", CROSS_SQL)
def ts_kinematics_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    """What is derived from positions against what a frame gives, by band of the given speed: bias and mean error of speed, heading
    and acceleration, the lag that is best in most of the band's tracks, and the speed's error after that shift."""
    w = in_track()
    shifted = {f"s{k + 3}": (F.lag("speed", k) if k >= 0 else F.lead("speed", -k)).over(w) for k in LAGS}
    k = headed(spark, d).withColumns({"accel": T.gradient(c("speed"), c("h"), w), "given_accel": T.gradient(c("x"), c("h"), w), **shifted, "band": F.expr(BANDS), "turn": F.abs(X.wrap(c("y") * 3.6 - c("heading")))})
    best = k.groupBy("track").agg(F.array_max(F.filter(F.array(*[F.struct(R(F.corr("x", f"s{j + 3}"), 9).alias("r"), F.lit(j).alias("k")) for j in LAGS]), lambda v: v["r"].isNotNull()))["k"].alias("lag"))
    votes = k.select("band", "track").distinct().join(best.where("lag is not null"), "track").groupBy("band", "lag").agg(F.count("*").alias("n"))
    modal = votes.groupBy("band").agg(F.max_by("lag", F.struct("n", -c("lag"))).alias("lag"))  # a row a band
    k = k.join(F.broadcast(modal), "band", "left").withColumn("moved", F.coalesce(*[F.when(c("lag") == j, c(f"s{j + 3}")) for j in LAGS]))
    gap, pull = c("speed") - c("x"), c("accel") - c("given_accel")
    return k.groupBy("band").agg(
        F.count("*").alias("n"), R(F.avg(gap), 3).alias("speed_bias"), R(F.avg(F.abs(gap)), 3).alias("speed_mae"), R(F.avg(F.abs(gap)) / F.greatest(F.avg("x"), F.lit(1e-6))).alias("speed_mae_share"),
        R(F.avg("turn"), 3).alias("heading_mae"), R(F.avg(pull), 3).alias("accel_bias"), R(F.avg(F.abs(pull)), 3).alias("accel_mae"), F.max("lag").alias("lag"), R(F.avg(F.abs(c("moved") - c("x"))), 3).alias("shifted_mae"),
    )


SMOOTHERS = ("raw", "savgol5", "savgol7", "kalman")


def smoothed(spark: SparkSession, d: str) -> DataFrame:
    """Frames, one per track and time, with their positions by each smoother: (smoother, track, id, us, h, x, y).

    Tables are read once for all smoothers and rows stay partitioned by track. Kalman needs a track and a time.
    """
    o = T.with_kalman(one(spark, d).select("track", "id", "us", "h", "x", "y"), ["track"], "h", {"x": "x_kalman", "y": "y_kalman"}, 0.5, 4.0)
    for name in ("savgol5", "savgol7"):
        for v in ("x", "y"):
            o = T.savgol(o, ["track"], ["us", "id"], v, int(name[-1]), 2).withColumnRenamed("smooth", f"{v}_{name}")
    of = lambda v, name: c(v if name == "raw" else f"{v}_{name}").alias(v)
    o = o.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(name).alias("smoother"), of("x", name), of("y", name)) for name in SMOOTHERS])))
    return o.where("_s.smoother != 'kalman' or (track is not null and h is not null)").select("_s.smoother", "track", "id", "us", "h", "_s.x", "_s.y")


@query("ts_smoother_diagnostics")
def ts_smoother_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Smoothers by what they make of each track, and the one to take."""
    long = headed_from(smoothed(spark, d), "smoother").select("smoother", "track", "us", "h", "speed", "heading")
    out = T.smoother_diagnostics(long, accel_cap=50.0, phase=0.3, least_speed=5.0, most_exceed=0.3, least_rising=0.4)
    return out.select("smoother", "tracks", *[R(k, 4).alias(k) for k in ("exceed_share", "rising_share", "peak_speed", "time_to_peak", "heading_sd", "rms_to_ensemble")], "eligible", "recommended")


@query("ts_orientation_divergence", f"WITH {HEAD} SELECT label, round(avg(CASE WHEN abs((x * 7.2 - heading + 540) % 360 - 180) > 60 THEN 1.0 ELSE 0 END), 6) AS share FROM hd GROUP BY 1")
def ts_orientation_divergence(spark: SparkSession, d: str) -> DataFrame:
    return headed(spark, d).groupBy("label").agg(R(F.avg((F.abs(X.wrap(c("x") * 7.2 - c("heading"))) > 60).cast("double"))).alias("share"))


@query("ts_heading_break", f"WITH {HEAD}, {UNWRAP}, t AS (SELECT *, h - min(h) OVER (PARTITION BY track) AS r, abs(dh) + coalesce(abs(lead(dh) OVER w), 0) AS near, lead(h) OVER w - h AS gap, x - first_value(x) OVER w AS depth FROM u {W}) SELECT track, min(us) AS broke_at, round(arg_min(r, (us, id)), 6) AS after, round(arg_min(depth, (us, id)), 4) AS depth FROM t WHERE r >= 24 AND near >= 120 AND gap <= 24 GROUP BY 1")
def ts_heading_break(spark: SparkSession, d: str) -> DataFrame:
    t = turned(spark, d).withColumn("r", c("h") - F.min("h").over(Window.partitionBy("track")))
    t = t.withColumn("near", F.abs("dh") + F.coalesce(F.abs(F.lead("dh").over(in_track())), F.lit(0.0))).withColumn("gap", F.lead("h").over(in_track()) - c("h"))
    t = t.withColumn("depth", c("x") - F.first("x").over(in_track()))
    at = F.struct("us", "id")
    return t.where("r >= 24 and near >= 120 and gap <= 24").groupBy("track").agg(F.min("us").alias("broke_at"), R(F.min_by("r", at)).alias("after"), R(F.min_by("depth", at), 4).alias("depth"))


@query("ts_get_off_probe", f"WITH {HEAD}, s AS (SELECT track, min(us) AS snap FROM e WHERE label = (SELECT min(label) FROM e) GROUP BY 1), f AS (SELECT hd.track, min(us - snap) AS off FROM hd JOIN s ON hd.track = s.track WHERE us >= snap AND speed > 5 GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN off <= 3600000000 * 6 THEN 1.0 ELSE 0 END), 6) AS share FROM f")
def ts_get_off_probe(spark: SparkSession, d: str) -> DataFrame:
    e = frames(spark, d)
    first = F.broadcast(e.agg(F.min("label").alias("m")))
    snap = e.join(first, c("label") == c("m"), "left_semi").groupBy("track").agg(F.min("us").alias("snap"))
    f = headed(spark, d).join(snap, "track").where("us >= snap and speed > 5").groupBy("track").agg(F.min(c("us") - c("snap")).alias("off"))
    return f.agg(F.count("*").alias("n"), R(F.avg((c("off") <= 3_600_000_000 * 6).cast("double"))).alias("share"))
