"""Centres of point groups and how well events agree with them.

Groups (drills) are few and so are their centres: the driver holds groups x centres coordinates. Points, cells and events stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import settled

c = F.col
ROUNDS, STILL = 25, 1e-4
Centres = dict[object, list[tuple[float, float]]]


def density_seeds(points: DataFrame, by: str, k: int, cell: float, apart: float) -> Centres:
    """Up to k middles of the densest cells of each group, each at least `apart` from those before.

    Each round takes the best cell that is left among all, however many there are, in one aggregation of the cell table. Equal counts go to the smaller
    cell. Where no cell is far enough, the densest that isn't a seed yet is taken.
    """
    at = lambda v: F.floor((c(v) - c(f"_{v}0")) / cell)
    start = points.groupBy(by).agg(*[(F.min(v) - cell).alias(f"_{v}0") for v in ("x", "y")])
    cells = points.join(F.broadcast(start), by).groupBy(by, at("x").alias("gx"), at("y").alias("gy"), "_x0", "_y0").agg(F.count("*").alias("n"))
    cells = cells.select(by, "gx", "gy", "n", (c("_x0") + (c("gx") + 0.5) * cell).alias("x"), (c("_y0") + (c("gy") + 0.5) * cell).alias("y"))
    cells, out = settled(cells), {}
    for _ in range(k):
        left = with_centres(cells, by, out)
        gap = lambda s: F.sqrt(F.pow(c("x") - s["x"], 2) + F.pow(c("y") - s["y"], 2))
        fresh = left.where(~F.exists("_centres", lambda s: gap(s) == 0)).withColumn("_far", F.forall("_centres", lambda s: gap(s) >= apart))
        best = fresh.groupBy(by).agg(F.max_by(F.struct("x", "y"), F.struct("_far", "n", -c("gx"), -c("gy"))).alias("s"))
        for r in best.collect():
            out.setdefault(r[by], []).append((r["s"]["x"], r["s"]["y"]))
    return out


def with_centres(df: DataFrame, by: str, centres: Centres) -> DataFrame:
    """df with _centres, the array of (k, x, y) of the row's group; empty for a group without any."""
    rows = [(g, [(i, float(x), float(y)) for i, (x, y) in enumerate(v)]) for g, v in centres.items()]
    table = df.sparkSession.createDataFrame(rows, f"_by {dict(df.dtypes)[by]}, _centres array<struct<k:int,x:double,y:double>>")
    return df.join(F.broadcast(table), c(by).eqNullSafe(c("_by")), "left").drop("_by").withColumn("_centres", F.expr("coalesce(_centres, cast(array() as array<struct<k:int,x:double,y:double>>))"))


def nearest(df: DataFrame, by: str, centres: Centres) -> DataFrame:
    """Rows of groups that have centres, with centre (its number), distance, and line_distance along x alone."""
    if len(centres) == 1:  # the usual case: the few numbers stand in the expression, no join
        (group, v), *_ = centres.items()
        points = ", ".join(f"named_struct('d', pow(x - {float(a)!r}D, 2) + pow(y - {float(b)!r}D, 2), 'k', {i})" for i, (a, b) in enumerate(v))
        lines = ", ".join(f"abs(x - {float(a)!r}D)" for a, _ in v)
        held = df.where(c(by).eqNullSafe(F.lit(group))).withColumns({"_n": F.expr(f"array_min(array({points}))"), "line_distance": F.expr(f"array_min(array({lines}))")})
    else:
        held = with_centres(df, by, centres).where(F.size("_centres") > 0)
        held = held.withColumns({"_n": F.expr("array_min(transform(_centres, s -> struct(pow(x - s.x, 2) + pow(y - s.y, 2) as d, s.k as k)))"), "line_distance": F.expr("array_min(transform(_centres, s -> abs(x - s.x)))")}).drop("_centres")
    return held.withColumns({"centre": F.expr("_n.k"), "distance": F.expr("sqrt(_n.d)")}).drop("_n")


def lloyd(points: DataFrame, by: str, centres: Centres, rounds: int = ROUNDS) -> Centres:
    """Centres moved to the means of the points nearest to them, until none moves by more than STILL. A round is one aggregation."""
    points = settled(points.select(by, "x", "y"))
    for _ in range(rounds):
        means = {(r[by], r["centre"]): (r["x"], r["y"]) for r in nearest(points, by, centres).groupBy(by, "centre").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()}
        moved = {g: [means.get((g, i), p) for i, p in enumerate(v)] for g, v in centres.items()}
        still = all(abs(a - b) <= STILL for g in centres for p, q in zip(centres[g], moved[g], strict=True) for a, b in zip(p, q, strict=True))
        centres = moved
        if still:
            break
    return centres


def visit_angles(points: DataFrame, keys: list[str], order: list[str], measured: Column) -> DataFrame:
    """keys, geometric, measured: for each visit between two others in a track, the angle between the ways to
    it and from it. Rows at the same centre (column centre) that follow each other are one visit, with its first row's place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = points.withColumn("_m", measured).withColumn("_new", ~c("centre").eqNullSafe(F.lag("centre").over(w))).where("_new")
    to = first.select(*keys, "_m", *[(c(v) - F.lag(v).over(w)).alias(f"a{v}") for v in "xy"], *[(F.lead(v).over(w) - c(v)).alias(f"b{v}") for v in "xy"])
    size = lambda s: F.sqrt(c(f"{s}x") * c(f"{s}x") + c(f"{s}y") * c(f"{s}y"))
    cos = (c("ax") * c("bx") + c("ay") * c("by")) / (size("a") * size("b"))
    return to.where((size("a") >= 1e-6) & (size("b") >= 1e-6)).select(*keys, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).alias("geometric"), c("_m").alias("measured"))


def score_events(events: DataFrame, by: str, attempt: str, order: list[str], k: int, cell: float, apart: float, radius: float) -> DataFrame:
    """One row per group: events of one half of the attempts give the centres, those of the other half are scored.

    An attempt's half is a bit of the MD5 of its key. precision is the share of events within radius of a centre, recall the events
    near one up to the modal number of an attempt over that number for each attempt; both by distance (point) and along x alone (line).
    events has x, y and angle. The angle error compares angle with that of the visits before and after.
    """
    events = settled(events)
    half = F.conv(F.substring(F.md5(c(attempt).cast("string")), -1, 1), 16, 10).cast("int") % 2
    estimate, scored = events.where(half == 0), events.where(half == 1)
    centres = lloyd(estimate, by, density_seeds(estimate, by, k, cell, apart))
    pairs = lambda v: [((a - p) ** 2 + (b - q) ** 2) ** 0.5 for i, (a, b) in enumerate(v) for p, q in v[i + 1 :]]
    known = events.sparkSession.createDataFrame([(g, len(v), min(pairs(v), default=None)) for g, v in centres.items()], f"_by {dict(events.dtypes)[by]}, centres int, separation double")
    at = nearest(scored, by, centres)
    out = events.groupBy(by).agg(F.count_if(half == 0).alias("turns_estimate"), F.count_if(half == 1).alias("turns_eval")).join(F.broadcast(known), c(by).eqNullSafe(c("_by")), "left").drop("_by")
    for model, distance in (("point", "distance"), ("line", "line_distance")):
        tries = at.groupBy(by, attempt).agg(F.count_if(c(distance) <= radius).alias("near"), F.count("*").alias("n"))
        levels = tries.groupBy(by, "near").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
        modal = levels.groupBy(by).agg(F.max_by("near", F.struct("m", -c("near"))).alias("e"))
        s = levels.join(F.broadcast(modal), by).groupBy(by, "e").agg(F.sum(c("near") * c("m")).alias(f"matched_{model}"), F.sum("n").alias("n"), F.sum(F.least("near", "e") * c("m")).alias("reached"), F.sum("m").alias("m"))
        s = s.select(by, f"matched_{model}", (c(f"matched_{model}") / c("n")).alias(f"precision_{model}"), F.coalesce(F.try_divide(c("reached"), c("e") * c("m")), F.lit(0.0)).alias(f"recall_{model}"), c("e").alias(f"expected_{model}"))
        out = out.join(s, by, "left")
    errors = visit_angles(at, [by, attempt], order, F.abs("angle")).groupBy(by).agg(F.count("*").alias("angle_n"), F.median(F.abs(c("geometric") - c("measured"))).alias("angle_error"))
    return out.join(errors, by, "left")
