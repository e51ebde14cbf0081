"""Queries of section 2.10: turn events and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swerve.operators import geometry as G
from swerve.operators import tracks as T
from swerve.operators import turns as U
from swerve.operators.stats import settled
from swerve.sources.tables import FRAMES, TURNS, frames, read, turns

from .aggregating import R
from .ordering import in_track
from .registry import query
from .tracking import HEAD, SMOOTHERS, UNWRAP, grad_sql, headed, smoothed, turned, turned_from

c = F.col
RUN = f"{HEAD}, {UNWRAP}, r AS (SELECT *, row_number() OVER w - 1 AS i, sum(dh) OVER w AS turned FROM u WINDOW w AS (PARTITION BY track ORDER BY us, id))"
TRIG = "tr AS (SELECT *, abs(lead(turned, 4) OVER w - turned) AS score, max(speed) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS top FROM r WINDOW w AS (PARTITION BY track ORDER BY i))"


def run_of(t: DataFrame, *more: str) -> DataFrame:
    return U.indexed(t.withColumn("turned", F.sum("dh").over(in_track(*more))), [*more, "track"], ["us", "id"])


def running(spark: SparkSession, d: str) -> DataFrame:
    return run_of(turned(spark, d))


@query("turn_trigger", f"WITH {RUN}, {TRIG} SELECT track, i::BIGINT AS i, round(score, 3) AS score FROM tr WHERE score >= 60 AND top >= 2")
def turn_trigger(spark: SparkSession, d: str) -> DataFrame:
    return U.triggers(running(spark, d), ["track"], 4, 60.0, 2.0).select("track", "i", R("score", 3).alias("score"))


@query("turn_nms")
def turn_nms(spark: SparkSession, d: str) -> DataFrame:
    return U.accepted(U.triggers(running(spark, d), ["track"], 4, 60.0, 2.0), ["track"], 5).select("track", "i", R("score", 3).alias("score"))


@query("turn_segment")
def turn_segment(spark: SparkSession, d: str) -> DataFrame:
    r = running(spark, d)
    return U.segments(r, U.accepted(U.triggers(r, ["track"], 4, 60.0, 2.0), ["track"], 5), ["track"], 4, 6).select("track", "hit", "apex", "first", "last")


@query("detect_turns")
def detect_turns(spark: SparkSession, d: str) -> DataFrame:
    return U.detect(running(spark, d), ["track"]).select("track", "hit", "apex", "first", "last", R("score", 3).alias("score"))


@query("turn_metrics")
def turn_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = settled(running(spark, d))  # read by detection and by the measures
    m = U.metrics(r, U.detect(r, ["track"]), ["track"])
    return m.select("track", "hit", *[R(k, 3).alias(k) for k in ("entry", "slowest", "exit", "angle", "retention", "apex_retention", "radius", "residual", "lateral")], "regain", "valid")


CIRCLE = "cg AS (SELECT tr.track, tr.i AS hit, r.x, r.y FROM tr JOIN r ON r.track = tr.track AND r.i BETWEEN tr.i AND tr.i + 6 WHERE score >= 60 AND top >= 2), ck AS (SELECT track, hit, x - avg(x) OVER h AS u, y - avg(y) OVER h AS v FROM cg WINDOW h AS (PARTITION BY track, hit)), cz AS (SELECT track, hit, count(*) AS n, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*u*u) AS uuu, sum(v*v*v) AS vvv, sum(u*v*v) AS uvv, sum(v*u*u) AS vuu FROM ck GROUP BY 1, 2), cq AS (SELECT *, uu*vv - uv*uv AS det FROM cz), co AS (SELECT track, hit, n, uu, vv, CASE WHEN abs(det) > 1e-9 THEN ((uuu+uvv)/2*vv - (vvv+vuu)/2*uv) / det END AS cu, CASE WHEN abs(det) > 1e-9 THEN ((vvv+vuu)/2*uu - (uuu+uvv)/2*uv) / det END AS cv FROM cq), c2 AS (SELECT *, sqrt(cu * cu + cv * cv + (uu + vv) / n) AS radius FROM co)"


@query("turn_circle_fit", f"WITH {RUN}, {TRIG}, {CIRCLE} SELECT c2.track, c2.hit::BIGINT AS hit, round(CASE WHEN radius < 1000 THEN radius END, 3) AS radius, round(CASE WHEN radius < 1000 THEN sqrt(avg(power(sqrt(power(u - cu, 2) + power(v - cv, 2)) - radius, 2))) END, 3) AS residual FROM c2 JOIN ck ON ck.track = c2.track AND ck.hit = c2.hit GROUP BY c2.track, c2.hit, radius")
def turn_circle_fit(spark: SparkSession, d: str) -> DataFrame:
    """The circle through the seven frames from each trigger on; none where it is nearly a line."""
    r = running(spark, d)
    hits = U.triggers(r, ["track"], 4, 60.0, 2.0).select("track", c("i").alias("hit"), c("i").alias("first"), (c("i") + 6).alias("last"))
    fit = U.circle(U.points(r, hits, ["track"]), ["track", "hit"], "x", "y")
    bent = lambda v: R(F.when(c("radius") < 1000, c(v)), 3).alias(v)
    return fit.select("track", "hit", bent("radius"), bent("residual"))


@query("turn_plant_class")
def turn_plant_class(spark: SparkSession, d: str) -> DataFrame:
    r = running(spark, d)
    m = U.metrics(r, U.detect(r, ["track"]), ["track"])
    return m.groupBy(U.plant_class(m).alias("kind"), "valid").agg(F.count("*").alias("n"))


MEASURES = ("score", "angle", "entry", "exit", "retention", "apex_retention")


BY_SMOOTHER = ["smoother", "track"]


def by_smoother(spark: SparkSession, d: str) -> DataFrame:
    """Numbered frames of each track by each smoother, with their running heading."""
    return run_of(turned_from(smoothed(spark, d), "smoother"), "smoother").select(*BY_SMOOTHER, "i", "speed", "dh", "turned")


def smoother_range(found: DataFrame, reach: int = 3) -> DataFrame:
    """Of each raw turn: in how many other smoothers it is found within `reach` frames (the nearest, then the earlier), and the range of each measure over them and itself."""
    main = found.where("smoother = 'raw'").select("track", "apex", *[c(m).alias(f"own_{m}") for m in MEASURES])
    other = found.where("smoother != 'raw'").select("track", "smoother", c("apex").alias("oa"), F.struct(*MEASURES).alias("m"))
    asks = main.select("track", "apex", F.explode(F.sequence(c("apex") - reach, c("apex") + reach)).alias("oa"))
    near = asks.join(other, ["track", "oa"]).groupBy("track", "apex", "smoother").agg(F.min_by("m", F.struct(F.abs(c("apex") - c("oa")).alias("g"), "oa")).alias("m"))
    span = near.groupBy("track", "apex").agg(F.count("*").alias("matched"), *[f(f"m.{m}").alias(f"{k}_{m}") for m in MEASURES for k, f in (("least", F.min), ("most", F.max))])
    out = main.join(span, ["track", "apex"], "left")
    both = [R(f(f"own_{m}", f"{k}_{m}"), 3).alias(f"{o}_{m}") for m in MEASURES for o, k, f in (("lo", "least", F.least), ("hi", "most", F.greatest))]
    return out.select("track", "apex", F.coalesce("matched", F.lit(0).cast("long")).alias("matched"), *both)


@query("turn_smoother_range")
def turn_smoother_range(spark: SparkSession, d: str) -> DataFrame:
    r = settled(by_smoother(spark, d))  # read by detection and by the measures
    return smoother_range(settled(U.ends(r, U.detect(r, BY_SMOOTHER), BY_SMOOTHER).select(*BY_SMOOTHER, "apex", *MEASURES)))


SPEED_CAP, ACCEL_CAP = 200.0, 50.0


@query("turn_attempt_table")
def turn_attempt_table(spark: SparkSession, d: str) -> DataFrame:
    """A row per track, turns or not: frames, frames above the caps of speed and acceleration, turns after each smoother and in each one's
    shuffled increments, and turns of the raw track by each segmentation."""
    keys = [*BY_SMOOTHER, "dealt"]
    both = F.explode(F.array(F.struct(F.lit(False).alias("dealt"), "turned"), F.struct(F.lit(True).alias("dealt"), c("dealt_turned").alias("turned"))))
    rows = shuffled(by_smoother(spark, d), BY_SMOOTHER, out="dealt_turned").select(*BY_SMOOTHER, "i", "speed", both.alias("_b")).select(*BY_SMOOTHER, "_b.dealt", "i", "speed", "_b.turned")
    # a turn of the raw track by both segmentations, any other by the walk
    ways = F.array(F.struct(F.lit("walk").alias("way"), "walk.*"), F.struct(F.lit("window").alias("way"), "window.*"))
    hits = U.located(rows, keys).select(*keys, "hit", "score", F.explode(ways).alias("_w")).where("_w.way = 'walk' or (smoother = 'raw' and not dealt)").select(*keys, "hit", "score", "_w.*")
    kind = F.when(c("way") == "window", "seg_window").otherwise(F.concat(F.when(c("dealt"), "null_").otherwise("turns_"), "smoother"))
    names = [f"{k}_{s}" for k in ("turns", "null") for s in SMOOTHERS] + ["seg_window"]
    n = U.without_overlap(hits, [*keys, "way"]).groupBy("track").agg(*[F.count_if(kind == k).alias(k) for k in names]).withColumn("seg_walk", c("turns_raw"))
    accel = T.gradient(c("speed"), c("h"), in_track())
    all_ = headed(spark, d).withColumn("a", accel).groupBy("track").agg(F.count("*").alias("n_frames"), F.count_if(c("speed") > SPEED_CAP).alias("speed_above_cap"), F.count_if(F.abs("a") > ACCEL_CAP).alias("accel_above_cap"))
    return all_.join(n, "track", "left").select("track", "n_frames", "speed_above_cap", "accel_above_cap", *[F.coalesce(c(k), F.lit(0).cast("long")).alias(k) for k in [*names[:-1], "seg_walk", "seg_window"]])


def shuffled(r: DataFrame, keys: list[str] = ["track"], seed: int = 7, out: str = "turned") -> DataFrame:  # noqa: B006
    """Heading increments dealt anew within each track, their running sum as `out`; speeds stay where they are. Frames without a key go.

    A frame stands at its own number and, for its increment, at its number in the new order; so each meets the
    increment it is dealt as the next row, without a join.
    """
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "track", "i")))
    rows = r.where(" and ".join(f"{k} is not null" for k in keys)).withColumn("_at", (F.row_number().over(order) - 1).cast("long"))
    cols = [x for x in rows.columns if x not in ("i", "_at", out)]
    twice = rows.select(*cols, F.posexplode(F.array("i", "_at")).alias("_dealt", "i"))
    met = twice.withColumn("new_dh", F.lead("dh").over(Window.partitionBy(*keys).orderBy("i", "_dealt"))).where("_dealt = 0").drop("_dealt")
    return met.withColumn(out, F.sum("new_dh").over(Window.partitionBy(*keys).orderBy("i")))


@query("turn_null_shuffle")
def turn_null_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return U.detect(shuffled(running(spark, d)), ["track"]).groupBy("track").agg(F.count("*").alias("null_turns"))


DEALT = f"n1 AS (SELECT track, dh, row_number() OVER (PARTITION BY track ORDER BY md5('7:' || track || ':' || i)) - 1 AS i FROM r), r0 AS (SELECT r.track, r.i, r.label, r.speed, r.h, sum(n1.dh) OVER (PARTITION BY r.track ORDER BY r.i) AS turned FROM r JOIN n1 ON r.track = n1.track AND r.i = n1.i), {TRIG.replace('tr AS', 't0 AS').replace('FROM r ', 'FROM r0 ')}"


@query("turn_sanity_rates", f"WITH {RUN}, {TRIG}, {DEALT}, g AS (SELECT track, i, {grad_sql('speed')} AS accel FROM r WINDOW w AS (PARTITION BY track ORDER BY us, id)), a AS (SELECT tr.label, tr.speed, g.accel, coalesce(tr.score >= 60 AND tr.top >= 2, false) AS hit, coalesce(t0.score >= 60 AND t0.top >= 2, false) AS dealt FROM tr JOIN t0 ON tr.track = t0.track AND tr.i = t0.i JOIN g ON tr.track = g.track AND tr.i = g.i) SELECT label, count(*) AS frames, round(1000.0 * sum(hit::INT) / count(*), 4) AS per_1000, round(1000.0 * sum(dealt::INT) / count(*), 4) AS null_per_1000, round(sum(hit::INT)::DOUBLE / nullif(sum(dealt::INT), 0), 6) AS to_null, round(avg((speed > {SPEED_CAP})::INT), 6) AS above_speed, round(avg(coalesce(abs(accel) > {ACCEL_CAP}, false)::INT), 6) AS above_accel FROM a GROUP BY ROLLUP (label)")
def turn_sanity_rates(spark: SparkSession, d: str) -> DataFrame:
    """Detections per 1,000 frames by label, those in shuffled increments, and the share of frames above the caps of speed and acceleration."""
    r = settled(running(spark, d))
    hit = lambda rows, name: U.triggers(rows, ["track"], 4, 60.0, 2.0).select("track", "i", F.lit(1).alias(name))
    a = r.withColumn("accel", T.gradient(c("speed"), c("h"), in_track())).join(hit(r, "hit"), ["track", "i"], "left").join(hit(shuffled(r), "dealt"), ["track", "i"], "left")
    share = lambda x: R(F.avg(F.coalesce(x, F.lit(False)).cast("double")))
    return a.rollup("label").agg(F.count("*").alias("frames"), R(1000.0 * F.count("hit") / F.count("*"), 4).alias("per_1000"), R(1000.0 * F.count("dealt") / F.count("*"), 4).alias("null_per_1000"), R(F.try_divide(F.count("hit"), F.count("dealt"))).alias("to_null"), share(c("speed") > SPEED_CAP).alias("above_speed"), share(F.abs("accel") > ACCEL_CAP).alias("above_accel"))


def threshold_delta(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two settings compared: for all turns, by label and by track, their turns, those of 30 to 60 and of 120 to 150
    degrees, matched, lost and new ones, and how far the change is more than that of the shuffled tracks.

    found is (track, apex, label, angle, strict, dealt), pairs the matched apexes (track, a, b) of the loose and the strict setting.
    """
    turn = found.where("not dealt").join(pairs.select("track", c("a").alias("apex"), F.lit(False).alias("strict"), F.lit(1).alias("m")).union(pairs.select("track", c("b").alias("apex"), F.lit(True).alias("strict"), F.lit(1).alias("m"))), ["track", "apex", "strict"], "left")
    rows = turn.select("track", "label", "angle", "strict", "dealt", "m").union(found.where("dealt").select("track", "label", "angle", "strict", "dealt", F.lit(None).cast("int")))
    scopes = F.explode(F.array(F.struct(F.lit("all").alias("scope"), F.lit("all").alias("key")), F.struct(F.lit("label").alias("scope"), c("label").alias("key")), F.struct(F.lit("track").alias("scope"), c("track").cast("string").alias("key"))))
    rows = rows.select("*", scopes.alias("s")).select("s.*", "*")
    size, real = F.abs("angle"), ~c("dealt")
    counts = {"turns": F.lit(True), "from_30": (size >= 30) & (size < 60), "from_120": (size >= 120) & (size < 150)}
    aggs = [F.count_if(real & (c("strict") == strict) & what).alias(f"{k}_{name}") for k, what in counts.items() for name, strict in (("loose", False), ("strict", True))]
    aggs += [F.count_if(c("dealt") & (c("strict") == strict)).alias(f"null_{name}") for name, strict in (("loose", False), ("strict", True))]
    aggs += [F.count_if(real & c("strict") & (c("m") == 1)).alias("matched"), F.count_if(real & ~c("strict") & c("m").isNull()).alias("lost"), F.count_if(real & c("strict") & c("m").isNull()).alias("new")]
    out = rows.groupBy("scope", "key").agg(*aggs)
    return out.withColumn("delta", c("turns_strict") - c("turns_loose")).withColumn("excess", c("delta") - (c("null_strict") - c("null_loose")))


@query("turn_threshold_delta")
def turn_threshold_delta(spark: SparkSession, d: str) -> DataFrame:
    """Turns of 60 degrees and more against those of 90 and more, also in the shuffled increments."""
    r, found = settled(running(spark, d)), None
    for dealt, rows in ((False, r), (True, shuffled(r))):
        for strict, least in ((False, 60.0), (True, 90.0)):
            f = U.ends(rows, U.detect(rows, ["track"], least_turn=least), ["track"]).join(r.select("track", c("i").alias("apex"), "label"), ["track", "apex"])
            f = f.select("track", "apex", "label", "angle", F.lit(strict).alias("strict"), F.lit(dealt).alias("dealt"))
            found = f if found is None else found.union(f)
    found = settled(found)
    of = lambda strict: found.where(~c("dealt") & (c("strict") == strict))
    return threshold_delta(found, U.matched(of(False), of(True), ["track"], 3))


GRID, APART, RADIUS, CENTRES = 10.0, 20.0, 15.0, 4


def frame_centres(spark: SparkSession, d: str) -> G.Centres:
    """Centres of all frames: the densest cells, then means."""
    e = frames(spark, d).where("x is not null and y is not null").withColumn("drill", F.lit("all"))
    return G.lloyd(e, "drill", G.density_seeds(e, "drill", CENTRES, GRID, APART))


def centres_sql() -> str:
    """CTEs up to cz (k, x, y), the centres of the frames e."""
    gap = "sqrt(power(g.x - {s}.x, 2) + power(g.y - {s}.y, 2))"
    out = [f"e2 AS (SELECT x, y, min(x) OVER () - {GRID} AS x0, min(y) OVER () - {GRID} AS y0 FROM e WHERE x IS NOT NULL AND y IS NOT NULL)"]
    out.append(f"g AS MATERIALIZED (SELECT gx, gy, n, x0 + (gx + 0.5) * {GRID} AS x, y0 + (gy + 0.5) * {GRID} AS y FROM (SELECT floor((x - x0) / {GRID}) AS gx, floor((y - y0) / {GRID}) AS gy, any_value(x0) AS x0, any_value(y0) AS y0, count(*) AS n FROM e2 GROUP BY 1, 2))")
    for j in range(CENTRES):
        before = [f"s{i}" for i in range(j)]
        far = " AND ".join(f"{gap.format(s=s)} >= {APART}" for s in before) or "true"
        fresh = " AND ".join(f"{gap.format(s=s)} > 0" for s in before) or "true"
        out.append(f"s{j} AS MATERIALIZED (SELECT g.x, g.y FROM {', '.join(['g', *before])} WHERE {fresh} ORDER BY {f"{far} DESC, " if before else ""}n DESC, gx, gy LIMIT 1)")
    out.append("c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {j} AS k, x, y, false AS still FROM s{j}" for j in range(CENTRES)) + ")")
    for r in range(G.ROUNDS):
        out.append(f"n{r} AS MATERIALIZED (SELECT k, avg(px) AS x, avg(py) AS y FROM (SELECT e2.x AS px, e2.y AS py, arg_min(k, (power(e2.x - c.x, 2) + power(e2.y - c.y, 2), k)) AS k FROM (SELECT *, row_number() OVER () AS i FROM e2) e2, c{r} c GROUP BY i, e2.x, e2.y) GROUP BY k)")
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, CASE WHEN still THEN c.x ELSE coalesce(n.x, c.x) END AS x, CASE WHEN still THEN c.y ELSE coalesce(n.y, c.y) END AS y, still OR max(greatest(abs(coalesce(n.x, c.x) - c.x), abs(coalesce(n.y, c.y) - c.y))) OVER () <= {G.STILL} AS still FROM c{r} c LEFT JOIN n{r} n ON c.k = n.k)")
    return ", ".join([*out, f"cz AS (SELECT k, x, y FROM c{G.ROUNDS})"])


@query("geo_density_cones", f"WITH {FRAMES}, {centres_sql()}, a AS (SELECT i, arg_min(k, (power(p.x - cz.x, 2) + power(p.y - cz.y, 2), k)) AS k FROM (SELECT x, y, row_number() OVER () AS i FROM e2) p, cz GROUP BY i), m AS (SELECT k, count(*) AS n FROM a GROUP BY 1) SELECT cz.k::INTEGER AS centre, n, round(x, 3) AS x, round(y, 3) AS y FROM cz JOIN m ON cz.k = m.k")
def geo_density_cones(spark: SparkSession, d: str) -> DataFrame:
    found = frame_centres(spark, d)
    e = frames(spark, d).where("x is not null and y is not null").withColumn("drill", F.lit("all"))
    n = G.nearest(e, "drill", found).groupBy("centre").agg(F.count("*").alias("n"))
    points = spark.createDataFrame([(i, round(x, 3), round(y, 3)) for i, (x, y) in enumerate(found.get("all", []))], "centre int, x double, y double")
    return n.join(F.broadcast(points), "centre").select("centre", "n", "x", "y")


@query("geo_score")
def geo_score(spark: SparkSession, d: str) -> DataFrame:
    """Turns of one half of the tracks give the centres of each label, those of the other half are scored against them."""
    r = running(spark, d)
    found = U.metrics(r.drop("x", "y"), U.detect(r, ["track"]), ["track"]).select("track", c("apex").alias("i"), "angle")
    events = found.join(r.select("track", "i", "label", "x", "y"), ["track", "i"])
    s = G.score_events(events, "label", "track", ["i"], CENTRES, GRID, APART, RADIUS)
    whole = ("label", "centres", "turns_estimate", "turns_eval", "matched_point", "expected_point", "matched_line", "expected_line", "angle_n")
    return s.select(*whole, *[R(k).alias(k) for k in ("separation", "precision_point", "recall_point", "precision_line", "recall_line", "angle_error")])


VISITS = "v AS (SELECT u.track, u.us, u.id, u.x, u.y, u.dh, arg_min(k, (power(u.x - cz.x, 2) + power(u.y - cz.y, 2), k)) AS k FROM u, cz WHERE u.x IS NOT NULL AND u.y IS NOT NULL GROUP BY ALL), f AS (SELECT *, k IS DISTINCT FROM lag(k) OVER w AS new FROM v WINDOW w AS (PARTITION BY track ORDER BY us, id)), p AS (SELECT * FROM f WHERE new), s AS (SELECT track, abs(dh) AS m, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS qx, lead(y) OVER w - y AS qy FROM p WINDOW w AS (PARTITION BY track ORDER BY us, id)), a AS (SELECT track, m, degrees(acos(greatest(-1, least(1, (ax * qx + ay * qy) / (sqrt(ax * ax + ay * ay) * sqrt(qx * qx + qy * qy)))))) AS geo FROM s WHERE sqrt(ax * ax + ay * ay) >= 1e-6 AND sqrt(qx * qx + qy * qy) >= 1e-6)"


@query("geo_sequence_angle", f"WITH {HEAD}, {UNWRAP}, {centres_sql()}, {VISITS} SELECT track, count(*) AS triples, round(avg(geo), 3) AS angle, round(median(abs(geo - m)), 3) AS error FROM a GROUP BY 1")
def geo_sequence_angle(spark: SparkSession, d: str) -> DataFrame:
    """Visits of the centres in each track: the angle between the ways to and from a visit, and how far the measured turn at its first frame is from it."""
    at = G.nearest(turned(spark, d).where("x is not null and y is not null").withColumn("drill", F.lit("all")), "drill", frame_centres(spark, d))
    v = G.visit_angles(at, ["track"], ["us", "id"], F.abs("dh"))
    return v.groupBy("track").agg(F.count("*").alias("triples"), R(F.avg("geometric"), 3).alias("angle"), R(F.median(F.abs(c("geometric") - c("measured"))), 3).alias("error"))


@query("label_provenance_counts", f"WITH {TURNS} SELECT r_name AS family, count(DISTINCT player) AS players, count(DISTINCT play) AS plays, count(DISTINCT o_custkey) AS customers FROM t JOIN supplier ON player = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON play = o_orderkey GROUP BY 1")
def label_provenance_counts(spark: SparkSession, d: str) -> DataFrame:
    s, n, g, o = (read(spark, d, x) for x in ("supplier", "nation", "region", "orders"))
    t = turns(spark, d).join(s, c("player") == s.s_suppkey).join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(g), n.n_regionkey == g.r_regionkey).join(o, c("play") == o.o_orderkey, "left")
    return t.groupBy(c("r_name").alias("family")).agg(F.countDistinct("player").alias("players"), F.countDistinct("play").alias("plays"), F.countDistinct("o_custkey").alias("customers"))


