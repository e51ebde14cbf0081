"""Turn events in tracks: trigger, suppression, segments, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def indexed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Frames numbered from 0 in their track."""
    return df.withColumn("i", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def triggers(df: DataFrame, keys: list[str], width: int, least_turn: float, least_speed: float) -> DataFrame:
    """Frames from which the unwrapped heading changes enough in `width` frames at some speed.

    Needs columns i, turned (running heading) and speed; adds score, the size of the change.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    score = F.abs(F.lead("turned", width).over(w) - c("turned"))
    return df.withColumn("score", score).withColumn("top", F.max("speed").over(w.rowsBetween(0, width))).where((c("score") >= least_turn) & (c("top") >= least_speed))


def accepted(df: DataFrame, keys: list[str], apart: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Greedy suppression: best score first (ties by frame), none nearer than `apart` frames to a kept one. The columns
    of `carry` stay with their frame.

    Frames that lie `apart` or more from the one before begin a new run; runs don't touch each other, so
    each is settled by itself and no array holds a whole track.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    run = F.sum((c("i") - F.coalesce(F.lag("i").over(w), c("i")) >= apart).cast("long")).over(w)
    arrays = df.withColumn("_run", run).groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 6)).alias("s"), "i", *carry))).alias("cand"))

    def step(acc: Column, x: Column) -> Column:
        near = F.exists(acc, lambda k: F.abs(k["i"] - x["i"]) < apart)
        return F.when(near, acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate("cand", F.slice("cand", 1, 0), step)
    return arrays.select(*keys, F.explode(kept).alias("_k")).select(*keys, c("_k.i").alias("i"), (-c("_k.s")).alias("score"), *[f"_k.{x}" for x in carry])


def reaches(frames: DataFrame, keys: list[str], width: int, longest: int) -> DataFrame:
    """frames with walk and window: the turn (apex, first, last) of each frame if it were a hit.

    Both have the slowest frame of the frame and `width` after it as apex. window is these frames; walk the frames around the apex over
    which speed keeps rising away from it, `longest` frames at most on each side. All windows share one order, so no hit looks its turn up by a join.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    rows = frames.withColumns({"_falls": c("speed") < F.lag("speed").over(w), "_falls_back": c("speed") < F.lead("speed").over(w)})
    # the first frame after the apex that is slower than the one before ends the turn, and likewise before it
    end, start = F.min(F.when(c("_falls"), c("i") - 1)).over(w.rowsBetween(1, longest)), F.max(F.when(c("_falls_back"), c("i") + 1)).over(w.rowsBetween(-longest, -1))
    rows = rows.withColumns({"_first": F.coalesce(start, F.min("i").over(w.rowsBetween(-longest, 0))), "_last": F.coalesce(end, F.max("i").over(w.rowsBetween(0, longest)))})
    rows = rows.withColumns({"_a": F.min(F.struct("speed", "i", "_first", "_last")).over(w.rowsBetween(0, width)), "_end": F.max("i").over(w.rowsBetween(0, width))})
    walk, window = F.struct(c("_a.i").alias("apex"), c("_a._first").alias("first"), c("_a._last").alias("last")), F.struct(c("_a.i").alias("apex"), c("i").alias("first"), c("_end").alias("last"))
    return rows.withColumns({"walk": walk, "window": window}).drop("_falls", "_falls_back", "_first", "_last", "_a", "_end")


def segments(frames: DataFrame, hits: DataFrame, keys: list[str], width: int, longest: int) -> DataFrame:
    """One row per hit: its apex (slowest frame in the window) and the frames around it over which
    speed keeps rising away from the apex, `longest` frames at most on each side."""
    rows = reaches(frames.select(*keys, "i", "speed"), keys, width, longest)
    return hits.join(rows, [*keys, "i"]).select(*keys, c("i").alias("hit"), "score", "walk.*")


def window_segments(frames: DataFrame, hits: DataFrame, keys: list[str], width: int) -> DataFrame:
    """As segments, but a turn is the window of its hit: the hit's frame and up to `width` after it."""
    w, at = Window.partitionBy(*keys).orderBy("i").rowsBetween(0, width), F.struct("speed", "i")
    rows = frames.select(*keys, "i", F.min(at).over(w)["i"].alias("apex"), F.max("i").over(w).alias("last"))
    return hits.join(rows, [*keys, "i"]).select(*keys, c("i").alias("hit"), "score", "apex", c("i").alias("first"), "last")


def without_overlap(seg: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Best score first; a segment that lies by more than `share` in a kept one goes. Runs of segments that
    overlap are settled each by itself."""
    w = Window.partitionBy(*keys).orderBy("first", "last", "hit")
    new = c("first") > F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    seg = seg.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long")).withColumn("_run", F.sum("_new").over(w))
    s = F.struct((-c("score")).alias("s"), "hit", "apex", "first", "last")
    arrays = seg.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(s)).alias("segs"))

    def step(acc: Column, x: Column) -> Column:
        inside = F.exists(acc, lambda k: (F.least(k["last"], x["last"]) - F.greatest(k["first"], x["first"]) + 1) > share * (x["last"] - x["first"] + 1))
        return F.when(inside, acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate("segs", F.slice("segs", 1, 0), step)
    return arrays.select(*keys, F.explode(kept).alias("_k")).select(*keys, (-c("_k.s")).alias("score"), "_k.hit", "_k.apex", "_k.first", "_k.last")


def points(frames: DataFrame, found: DataFrame, keys: list[str], behind: int = 0, cols: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The frames of each turn, and `behind` more after it, by frame number: columns of found, j and cols."""
    each = found.withColumn("j", F.explode(F.sequence(c("first"), c("last") + behind)))
    return each.join(frames.select(*keys, c("i").alias("j"), *cols), [*keys, "j"])


def detect(frames: DataFrame, keys: list[str], width: int = 4, least_turn: float = 60.0, least_speed: float = 2.0, apart: int = 5, longest: int = 6, segmentation: str = "walk") -> DataFrame:
    """Trigger, suppress, segment, reject overlaps: one row per turn. segmentation is 'walk' (while speed rises away from the
    apex) or 'window' (the trigger's window)."""
    if segmentation not in ("walk", "window"):
        raise ValueError(f"unknown segmentation {segmentation!r}")
    hits = located(frames, keys, width, least_turn, least_speed, apart, longest)
    return without_overlap(hits.select(*keys, "hit", "score", f"{segmentation}.*"), keys)


def located(frames: DataFrame, keys: list[str], width: int = 4, least_turn: float = 60.0, least_speed: float = 2.0, apart: int = 5, longest: int = 6) -> DataFrame:
    """Trigger and suppress: one row per hit with its score and its turn by each segmentation. Frames without a key have none.
    Rows that are partitioned by some of the keys are not shuffled."""
    rows = frames.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, "i", "speed", "turned")
    hits = accepted(triggers(reaches(rows, keys, width, longest), keys, width, least_turn, least_speed), keys, apart, ("walk", "window"))
    return hits.withColumnRenamed("i", "hit")


def ends(frames: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """found with entry, slowest and exit speed, angle (the change of the running heading from first to last frame) and both
    retentions, from three frames of each turn."""
    at = found.select(*keys, "hit", "first", "apex", "last", F.explode(F.array_distinct(F.array("first", "apex", "last"))).alias("i")).join(frames.select(*keys, "i", "turned", "speed"), [*keys, "i"])
    pick = lambda k, v: F.max(F.when(c("i") == c(k), c(v)))
    m = at.groupBy(*keys, "hit").agg(pick("first", "speed").alias("entry"), pick("apex", "speed").alias("slowest"), pick("last", "speed").alias("exit"), (pick("last", "turned") - pick("first", "turned")).alias("angle"))
    kept = lambda v: F.when(c("entry") > 1e-9, c(v) / c("entry"))
    return found.join(m, [*keys, "hit"]).withColumn("retention", kept("exit")).withColumn("apex_retention", kept("slowest"))


def matched(a: DataFrame, b: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """(keys, a, b): apexes of two detections paired one to one within `reach` frames, nearest first, then by frames.

    Apexes of both that lie more than reach from the one before begin a new run. A pair never leaves its run, so each
    run is settled by itself, with the few pairs that it holds.
    """
    both = a.select(*keys, c("apex").alias("i"), F.lit(0).alias("side")).union(b.select(*keys, c("apex").alias("i"), F.lit(1).alias("side")))
    w = Window.partitionBy(*keys).orderBy("i", "side")
    both = both.withColumn("_run", F.sum((c("i") - F.coalesce(F.lag("i").over(w), c("i")) > reach).cast("long")).over(w))
    left, right = both.where("side = 0").select(*keys, "_run", c("i").alias("a")), both.where("side = 1").select(*keys, c("i").alias("b"))
    near = left.withColumn("b", F.explode(F.sequence(c("a") - reach, c("a") + reach))).join(right, [*keys, "b"])
    arrays = near.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(F.abs(c("a") - c("b")).alias("g"), "a", "b"))).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda k: (k["a"] == x["a"]) | (k["b"] == x["b"])), acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate("p", F.slice("p", 1, 0), step)
    return arrays.select(*keys, F.explode(kept).alias("_pair")).select(*keys, c("_pair.a").alias("a"), c("_pair.b").alias("b"))


def metrics(frames: DataFrame, found: DataFrame, keys: list[str], horizon: int = 10, longest_gap: float = 24.0, cap: float = 200.0) -> DataFrame:
    """Entry, apex and exit speed, retentions, angle, frames to regain the entry speed, and valid; with
    positions in frames also the radius, its residual and the lateral acceleration."""
    has_place = {"x", "y"} <= set(frames.columns)
    j = points(frames, found, keys, horizon, ("h", "speed", "turned", *(("x", "y") if has_place else ())))
    inside = c("j") <= c("last")
    pick = lambda k, v: F.max(F.when(c("j") == c(k), c(v)))
    m = j.groupBy(*keys, "hit", "apex", "first", "last", "score").agg(
        pick("first", "speed").alias("entry"), pick("apex", "speed").alias("slowest"), pick("last", "speed").alias("exit"),
        (pick("last", "turned") - pick("first", "turned")).alias("angle"), F.max(F.when(inside, c("speed"))).alias("top"),
        (pick("last", "h") - pick("first", "h")).alias("hours"), F.sort_array(F.collect_list(F.when(c("j") > c("last"), F.struct("j", "speed")))).alias("after"),
        *([F.collect_list(F.when(inside, F.struct(c("x").cast("double").alias("x"), c("y").cast("double").alias("y")))).alias("_p")] if has_place else []),
    )
    regained = F.array_min(F.transform(F.filter("after", lambda a: a["speed"] >= c("entry")), lambda a: a["j"]))
    m = m.withColumn("regain", regained - c("last")).withColumn("valid", (c("hours") <= longest_gap * (c("last") - c("first") + 1)) & (c("top") <= cap))
    safe = lambda v: F.when(c("entry") > 1e-9, c(v) / c("entry"))
    if has_place:  # the circle through the turn's frames, and what holding its slowest speed on it takes
        m = with_circle(m, "_p").drop("cx", "cy", "n").withColumn("lateral", F.try_divide(c("slowest") * c("slowest"), c("radius")))
    return m.withColumn("retention", safe("exit")).withColumn("apex_retention", safe("slowest")).drop("after")


def plant_class(m: DataFrame) -> Column:
    return F.when((c("apex_retention") <= 0.5) & (c("exit") >= 1.2 * c("slowest")), "plant").otherwise("arc")


def circle(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Algebraic circle through the points of each group: centre, radius and root mean square distance of the
    points from it (residual); null for points on a line. A group is a turn's few frames, so it is one array in one row."""
    p = points.groupBy(*keys).agg(F.collect_list(F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))).alias("_p"))
    return with_circle(p, "_p").select(*keys, "cx", "cy", "radius", "n", "residual")


def with_circle(df: DataFrame, points: str) -> DataFrame:
    """df with cx, cy, radius, residual and n of the circle through an array of (x, y)."""
    df = df.withColumns({"n": F.size(points).cast("double"), "_mx": F.expr(f"aggregate({points}, 0D, (a, s) -> a + s.x) / size({points})"), "_my": F.expr(f"aggregate({points}, 0D, (a, s) -> a + s.y) / size({points})")})
    df = df.withColumn("_o", F.expr(f"transform({points}, s -> struct(s.x - _mx as u, s.y - _my as v))"))
    moments = {"uu": "s.u * s.u", "vv": "s.v * s.v", "uv": "s.u * s.v", "uuu": "s.u * s.u * s.u", "vvv": "s.v * s.v * s.v", "uvv": "s.u * s.v * s.v", "vuu": "s.v * s.u * s.u"}
    df = df.withColumns({f"_{k}": F.expr(f"aggregate(_o, 0D, (a, s) -> a + {e})") for k, e in moments.items()})
    det, a, b = c("_uu") * c("_vv") - c("_uv") * c("_uv"), (c("_uuu") + c("_uvv")) / 2, (c("_vvv") + c("_vuu")) / 2
    df = df.withColumns({"_cu": F.when(F.abs(det) > 1e-9, (a * c("_vv") - b * c("_uv")) / det), "_cv": F.when(F.abs(det) > 1e-9, (b * c("_uu") - a * c("_uv")) / det)})
    df = df.withColumn("radius", F.sqrt(c("_cu") * c("_cu") + c("_cv") * c("_cv") + (c("_uu") + c("_vv")) / c("n")))
    df = df.withColumn("residual", F.expr("sqrt(aggregate(_o, 0D, (a, s) -> a + pow(hypot(s.u - _cu, s.v - _cv) - radius, 2)) / n)"))
    return df.withColumns({"cx": c("_cu") + c("_mx"), "cy": c("_cv") + c("_my")}).drop(points, "_o", "_mx", "_my", "_cu", "_cv", *[f"_{k}" for k in moments])
