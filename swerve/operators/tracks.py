"""Kinematics of ordered tracks. All windows of a track share one partitioning and order."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col


def track(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def fill_gaps(df: DataFrame, keys: list[str], t: str, values: list[str], dt: float, longest: float) -> DataFrame:
    """Linearly interpolated rows for gaps of at most `longest` at the nominal spacing; longer gaps stay.

    inserted marks new rows; n_long counts on each row whether a longer gap follows it.
    """
    w = track(keys, [t])
    nxt = F.lead(t).over(w)
    gap = nxt - c(t)
    steps = F.when(gap.isNotNull() & (gap <= longest), F.greatest(F.round(gap / dt).cast("int"), F.lit(1))).otherwise(1)
    wide = df.select(*keys, t, *values, nxt.alias("_nt"), *[F.lead(v).over(w).alias(f"_n_{v}") for v in values], steps.alias("_k"), (gap > longest).cast("int").alias("n_long"))
    rows = wide.withColumn("_i", F.explode(F.sequence(F.lit(0), c("_k") - 1)))
    f = c("_i") / c("_k")
    blend = lambda a, b: F.when(c("_i") == 0, c(a)).otherwise(c(a) + (c(b) - c(a)) * f)
    return rows.select(*keys, blend(t, "_nt").alias(t), *[blend(v, f"_n_{v}").alias(v) for v in values], (c("_i") > 0).alias("inserted"), F.when(c("_i") == 0, F.coalesce("n_long", F.lit(0))).otherwise(0).alias("n_long"))


def polynomial_row(size: int, at: int, degree: int) -> list[float]:
    """Weights that give a least-squares polynomial through `size` even points its value at point `at`."""
    x = np.vander(np.arange(size) - at, degree + 1, increasing=True).astype(float)
    return np.linalg.pinv(x)[0].tolist()


def savgol(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, degree: int) -> DataFrame:
    """Savitzky-Golay smoothing: fixed weights inside, polynomial weights by position at the ends.

    A track shorter than the window takes the largest odd window it holds; with fewer points than
    the polynomial needs it stays as it is.
    """
    w, whole = track(keys, order), Window.partitionBy(*keys)
    n, i, half = F.count("*").over(whole), F.row_number().over(w), window // 2
    near = F.array(*[F.coalesce(F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w), F.lit(0.0)) for k in range(-2 * half, 2 * half + 1)])
    rows = df.withColumn("_near", near).withColumn("_n", n).withColumn("_i", i - 1)
    sizes = [s for s in range(window, degree, -2) if s > degree]
    # the weights of every size and place in one literal, so a frame costs one sum however many sizes there are
    weights, begins = [], {}
    for s in sizes:
        begins[s] = len(weights) // window
        for at in range(s):
            weights += polynomial_row(s, at, degree) + [0.0] * (window - s)
    rows = rows.withColumn("_s", F.coalesce(*[F.when(c("_n") >= s, F.lit(s)) for s in sizes], F.lit(0)))
    h = F.floor(c("_s") / 2).cast("int")
    rows = rows.withColumn("_at", F.when(c("_i") < h, c("_i")).when(c("_i") > c("_n") - 1 - h, c("_i") - c("_n") + c("_s")).otherwise(h).cast("int"))
    rows = rows.withColumn("_w", (F.coalesce(*[F.when(c("_s") == s, F.lit(b)) for s, b in begins.items()], F.lit(0)) + c("_at")) * window)
    term = lambda k: F.when(c("_s") > k, F.get("_near", 2 * half - c("_at") + k) * F.get(F.lit(weights), c("_w") + k)).otherwise(0.0)
    out = F.when(c("_s") > 0, sum((term(k) for k in range(window)), F.lit(0.0))).otherwise(c(value)) if sizes else c(value)
    return rows.withColumn("smooth", out).drop("_near", "_n", "_i", "_s", "_at", "_w")


def per_track(df: DataFrame, keys: list[str], cols: list[str], out: list[str], of) -> DataFrame:
    """of(one array of doubles for each of cols, sorted by the first) of each track, as columns out.

    For recursions that need the state of the frame before: linear in the track, one track at a time.
    """
    df = df.select(*keys, *[c(x).cast("double").alias(x) for x in cols])
    schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(x, T.DoubleType()) for x in out]])

    def run(key, group):
        order = np.lexsort([group.column(x).to_numpy() for x in reversed(cols)])
        values = of(*[group.column(x).to_numpy()[order] for x in cols])
        n = len(values[0])
        fixed = [pa.array([k.as_py()] * n, group.schema.field(name).type) for name, k in zip(keys, key, strict=True)]
        return pa.Table.from_arrays([*fixed, *[pa.array(v, pa.float64()) for v in values]], names=[*keys, *out])

    return df.groupBy(*keys).applyInArrow(run, schema)


def _kalman(q: float, r: float):
    """(times, values) of a track, by time, to (times, smoothed values, rates)."""

    def smooth(ts: np.ndarray, z: np.ndarray) -> tuple[list[float], ...]:
        x, v, a, b, d = float(z[0]), 0.0, r, 0.0, 1.0
        states, gaps = [(x, v, a, b, d, x, v, a, b, d)], np.diff(ts).tolist()
        for dt, seen in zip(gaps, z[1:].tolist(), strict=True):
            xp = x + dt * v
            ap = a + 2 * dt * b + dt * dt * d + q * dt * dt * dt / 3
            bp, dp = b + dt * d + q * dt * dt / 2, d + q * dt
            k1, k2, e = ap / (ap + r), bp / (ap + r), seen - xp
            x, v, a, b, d, vp = xp + k1 * e, v + k2 * e, (1 - k1) * ap, (1 - k1) * bp, dp - k2 * bp, v
            states.append((x, v, a, b, d, xp, vp, ap, bp, dp))
        xs, vs = [x], [v]
        for k in range(len(states) - 2, -1, -1):  # the smoothed state one step later, with its own prediction
            x, v, a, b, d = states[k][:5]
            xp, vp, ap, bp, dp = states[k + 1][5:]
            det, dt = ap * dp - bp * bp, gaps[k]
            f11, f12, f21, f22 = a + dt * b, b, b + dt * d, d
            ex, ev = xs[-1] - xp, vs[-1] - vp
            xs.append(x + (f11 * dp - f12 * bp) / det * ex + (f12 * ap - f11 * bp) / det * ev)
            vs.append(v + (f21 * dp - f22 * bp) / det * ex + (f22 * ap - f21 * bp) / det * ev)
        return ts, xs[::-1], vs[::-1]

    return smooth


def kalman(df: DataFrame, keys: list[str], t: str, value: str, q: float, r: float) -> DataFrame:
    """Constant-velocity Kalman filter and RTS smoother, forwards and back over each track."""
    return per_track(df, keys, [t, value], [t, "smooth", "rate"], _kalman(q, r))


def with_kalman(df: DataFrame, keys: list[str], t: str, values: dict[str, str], q: float, r: float) -> DataFrame:
    """df with several columns smoothed as by kalman, {column: smoothed column}: one pass over each track, no join."""
    smooth, schema = _kalman(q, r), T.StructType([*df.schema.fields, *[T.StructField(out, T.DoubleType()) for out in values.values()]])

    def run(group):
        read = lambda k: group.column(k).cast(pa.float64()).to_numpy()
        ts = read(t)
        order = np.argsort(ts, kind="stable")
        for v, out in values.items():
            new = np.empty(len(ts))
            new[order] = smooth(ts[order], read(v)[order])[1]
            group = group.append_column(out, pa.array(new))
        return group

    return df.groupBy(*keys).applyInArrow(run, schema)


def gradient(value: Column, t: Column, w: Window) -> Column:
    """Second-order derivative on an uneven grid inside, one-sided at the ends."""
    b, a = t - F.lag(t).over(w), F.lead(t).over(w) - t
    left, right = F.lag(value).over(w), F.lead(value).over(w)
    inside = (b * b * right + (a * a - b * b) * value - a * a * left) / (a * b * (a + b))
    return F.when(b.isNull(), (right - value) / a).when(a.isNull(), (value - left) / b).otherwise(inside)


def hold_below(value: Column, speed: Column, floor: float, w: Window) -> Column:
    """The last value whose speed reached the floor; before any, the track's first value."""
    good = F.when(speed >= floor, value)
    return F.coalesce(F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def despike(df: DataFrame, keys: list[str], t: str, x: str, y: str, top_speed: float) -> DataFrame:
    """Keep the first frame and then each frame that the last kept one reaches within the top speed."""

    def keep(ts: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[list[float], ...]:
        rows = list(zip(ts.tolist(), xs.tolist(), ys.tolist(), strict=True))
        kept = rows[:1]
        for f in rows[1:]:
            p = kept[-1]
            if not math.hypot(f[1] - p[1], f[2] - p[2]) > top_speed * (f[0] - p[0]):
                kept.append(f)
        return tuple(map(list, zip(*kept, strict=True)))

    return per_track(df, keys, [t, x, y], [t, x, y], keep)


def crossing(df: DataFrame, keys: list[str], order: list[str], t: str, axis: str, distance: float, gap: float, longest: float, first: float) -> DataFrame:
    """keys, crossed, ok, crossed_at, gap, policy: the first time an axis reaches a distance, interpolated between the frames around it.

    Times count from the track's onset. A bracket of more than `gap` is a gap: within `first` of the onset it is 'forbidden', else it is
    'bridged' if shorter than `longest` and 'too_long' if not; without a gap the policy is 'none'. Only 'none' and 'bridged' give a time. Frames
    without a value are skipped. A track that never reaches the distance has crossed false; one that begins beyond it is reached at its first frame.
    """
    w = track(keys, order)
    rows = df.where(c(axis).isNotNull()).withColumn("_pt", F.lag(t).over(w)).withColumn("_pa", F.lag(axis).over(w))
    one = F.min_by(F.when(c(axis) >= distance, F.struct(c(t).alias("_t"), c(axis).alias("_a"), "_pt", "_pa")), F.when(c(axis) >= distance, F.struct(*order)))
    hit = df.select(*keys).distinct().join(rows.groupBy(*keys).agg(one.alias("f")), keys, "left").select(*keys, "f.*")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(distance - c("_pa"), c("_a") - c("_pa")), F.lit(0.0))))
    hit = hit.withColumn("_at", F.when(c("_pt").isNull(), c("_t")).otherwise(c("_pt") + (c("_t") - c("_pt")) * share)).withColumn("gap", F.when(c("_t").isNotNull(), F.coalesce(c("_t") - c("_pt"), F.lit(0.0))))
    policy = F.when(c("gap").isNull() | (c("gap") <= gap), "none").when(c("_at") <= first, "forbidden").when(c("gap") < longest, "bridged").otherwise("too_long")
    hit = hit.withColumn("policy", policy).withColumn("crossed", c("_t").isNotNull()).withColumn("ok", c("crossed") & c("policy").isin("none", "bridged"))
    return hit.select(*keys, "crossed", "ok", F.when(c("ok"), c("_at")).alias("crossed_at"), "gap", "policy")


def fit_exponential(df: DataFrame, keys: list[str], t: str, v: str, taus: list[float], finer: list[list[float]], least: int) -> DataFrame:
    """Least squares of v = vmax (1 - exp(-t / tau)) in each track: keys, found, tau, vmax, rmse, r2, at_lower, at_upper.

    vmax follows from tau, so tau alone is searched: among taus, then among the factors of each list of `finer` around the best, within the
    range of taus. A round is one aggregation with the sums of all its candidates; no row is repeated. Tracks of fewer than
    `least` frames or of no duration aren't fitted.
    """
    lo, hi = F.lit(taus[0]), F.lit(taus[-1])
    rows = df.where(F.col(t).isNotNull() & F.col(v).isNotNull()).select(*keys, F.col(t).cast("double").alias("_t"), F.col(v).cast("double").alias("_v"))
    best = None
    for candidates in [taus, *finer]:
        now = rows if best is None else rows.join(best.where("_tau is not null").select(*keys, "_tau"), keys)
        tau = [F.lit(x) if best is None else F.least(hi, F.greatest(lo, F.col("_tau") * x)) for x in candidates]
        rise = [1 - F.exp(-F.col("_t") / x) for x in tau]
        sums = [e for k, b in enumerate(rise) for e in (F.sum(F.col("_v") * b).alias(f"_p{k}"), F.sum(b * b).alias(f"_q{k}"))]
        own = [] if best is None else [F.first("_tau").alias("_tau")]
        s = now.groupBy(*keys).agg(*sums, *own, F.sum(F.col("_v") * F.col("_v")).alias("_vv"), F.count("*").alias("_n"), F.max("_t").alias("_last"), (F.var_pop("_v") * F.count("*")).alias("_spread"))
        left = lambda k: F.col("_vv") - F.col(f"_p{k}") * F.col(f"_p{k}") / F.col(f"_q{k}")
        each = F.array(*[F.struct(left(k).alias("sse"), x.alias("tau"), F.try_divide(F.col(f"_p{k}"), F.col(f"_q{k}")).alias("vmax")) for k, x in enumerate(tau)])
        fits = (F.col("_n") >= least) & (F.col("_last") > 0)
        best = s.withColumn("_b", F.when(fits, F.array_min(F.filter(each, lambda x: x["sse"].isNotNull())))).select(*keys, "_n", "_spread", F.col("_b.tau").alias("_tau"), F.col("_b.vmax").alias("vmax"), F.col("_b.sse").alias("_sse"))
    out = df.select(*keys).distinct().join(best, keys, "left")
    return out.select(*keys, F.col("_tau").isNotNull().alias("found"), F.col("_tau").alias("tau"), "vmax", F.sqrt(F.greatest(F.col("_sse"), F.lit(0.0)) / F.col("_n")).alias("rmse"), (1 - F.try_divide(F.col("_sse"), F.col("_spread"))).alias("r2"), F.coalesce(F.col("_tau") <= lo, F.lit(False)).alias("at_lower"), F.coalesce(F.col("_tau") >= hi, F.lit(False)).alias("at_upper"))


def smoother_diagnostics(long: DataFrame, accel_cap: float, phase: float, least_speed: float, most_exceed: float, least_rising: float, least: int = 10) -> DataFrame:
    """Per smoother, over tracks of at least `least` frames: the mean share of frames beyond the acceleration cap, the mean share of
    rising speeds in the first `phase` of a track, the medians of peak speed, time to it, circular SD of the heading above least_speed and
    root mean square distance from the smoothers' median speed. Eligible smoothers keep both limits; the one nearest to
    the median among them is recommended, or, if there is none, the one that exceeds the cap least.

    long is (smoother, track, us, h, speed, heading) with the same frames for all smoothers. One window per track and one per frame; neither
    shuffles rows that are partitioned by track.
    """
    col = F.col
    w, whole = Window.partitionBy("smoother", "track").orderBy("us"), Window.partitionBy("smoother", "track")
    rows = long.withColumns({"n": F.count("*").over(whole), "i": F.row_number().over(w), "accel": gradient(col("speed"), col("h"), w), "rises": col("speed") > F.lag("speed").over(w), "start": F.min("h").over(whole)})
    rows = rows.where(col("n") >= least).withColumn("middle", F.median("speed").over(Window.partitionBy("track", "us")))
    fast, early = col("speed") > least_speed, col("i") <= F.greatest(F.lit(3), F.floor(col("n") * phase))
    a = F.radians(F.when(fast, col("heading")))
    length = F.hypot(F.avg(F.sin(a)), F.avg(F.cos(a)))
    each = rows.groupBy("smoother", "track").agg(
        F.avg((F.abs("accel") > accel_cap).cast("double")).alias("exceed"), F.avg(F.when(early, col("rises").cast("double"))).alias("rising"), F.max("speed").alias("peak"),
        (F.max_by("h", F.struct("speed", -col("i"))) - F.first("start")).alias("until"), F.when(F.count_if(fast) > 3, F.degrees(F.sqrt(-2 * F.log(F.least(F.lit(1.0), length))))).alias("sd"),
        F.sqrt(F.avg(F.pow(col("speed") - col("middle"), 2))).alias("rms"),
    )
    out = each.groupBy("smoother").agg(F.count("*").alias("tracks"), F.avg("exceed").alias("exceed_share"), F.avg("rising").alias("rising_share"), F.median("peak").alias("peak_speed"), F.median("until").alias("time_to_peak"), F.median("sd").alias("heading_sd"), F.median("rms").alias("rms_to_ensemble"))
    out = out.withColumn("eligible", (col("exceed_share") <= most_exceed) & (col("rising_share") >= least_rising))
    pick = F.row_number().over(Window.orderBy(F.desc("eligible"), F.when(col("eligible"), col("rms_to_ensemble")), "exceed_share", "smoother"))  # a row a smoother
    return out.withColumn("recommended", pick == 1)
