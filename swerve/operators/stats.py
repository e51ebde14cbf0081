"""Statistics as distributed aggregates: moments first, small solves on the driver.

What reaches the driver is a matrix of as many columns as the model has, or one row per replicate.
"""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swerve.functions.columns import hash_uniform

c = F.col
#: Standard errors of the least effect that a two-sided test at 5 % finds with a chance of 80 %.
DETECTABLE = 2.801585


def group_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and sum of squares about the mean of each group."""
    v = c(value)
    return df.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), (F.coalesce(F.var_pop(v), F.lit(0.0)) * F.count("*")).alias("ss"))


def icc1(m: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Unbalanced one-way ICC from group moments: k0, MSB, MSW, the estimate and whether it was clamped at 0."""
    n, mean = c("n"), c("mean")
    a = m.groupBy(*by).agg(F.count("*").alias("j"), F.sum(n).alias("total"), F.sum(n * n).alias("n2"), F.sum(n * mean).alias("nm"), F.sum(n * mean * mean).alias("nm2"), F.sum("ss").alias("ssw"))
    a = a.withColumn("k0", (c("total") - c("n2") / c("total")) / (c("j") - 1)).withColumn("msb", (c("nm2") - c("nm") * c("nm") / c("total")) / (c("j") - 1)).withColumn("msw", c("ssw") / (c("total") - c("j")))
    raw = (c("msb") - c("msw")) / (c("msb") + (c("k0") - 1) * c("msw"))
    return a.select(*by, "j", "k0", "msb", "msw", F.greatest(raw, F.lit(0.0)).alias("icc"), (raw < 0).alias("clamped"))


def gram(df: DataFrame, xs: list[str], y: str, by: list[str] = [], weight: Column | None = None) -> DataFrame:  # noqa: B006
    """Cross products of an intercept, the columns xs and y, per group: one aggregation."""
    cols = [F.lit(1.0), *[c(x).cast("double") for x in xs], c(y).cast("double")]
    w = weight if weight is not None else F.lit(1.0)
    n = len(cols)
    return df.where(c(y).isNotNull()).groupBy(*by).agg(*[F.sum(w * cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)])


def unpack(row, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    g = np.zeros((size + 1, size + 1))
    for i in range(size + 1):
        for j in range(i, size + 1):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g[:size, :size], g[:size, size], g[size, size]


def solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(xx, xy, rcond=None)[0]


def linear(xs: list[str], beta: np.ndarray) -> Column:
    return sum((c(x) * float(b) for x, b in zip(xs, beta[1:], strict=True)), F.lit(float(beta[0])))


def ols(df: DataFrame, xs: list[str], y: str, cluster: str | None = None, weight: str | None = None) -> dict:
    """Coefficients with HC1 or CR1 errors, least detectable effects (80 % power at 5 %), R2 and n; weighted
    least squares with a weight. Two passes: cross products, then scores."""
    p, w = len(xs) + 1, c(weight).cast("double") if weight else F.lit(1.0)
    xx, xy, _ = unpack(gram(df, xs, y, weight=w).first(), p)
    beta = solve(xx, xy)
    rows = df.where(c(y).isNotNull()).withColumn("_r", c(y) - linear(xs, beta)).withColumn("_w", w)
    score = [x * c("_w") * c("_r") for x in (F.lit(1.0), *[c(x).cast("double") for x in xs])]
    sums = [F.sum(c("_w") * c("_r") * c("_r")).alias("rr"), F.count("*").alias("n"), F.sum("_w").alias("sw"), F.sum(c("_w") * c(y)).alias("sy"), F.sum(c("_w") * c(y) * c(y)).alias("syy")]
    if cluster:
        rows = rows.groupBy(cluster).agg(*[F.sum(x).alias(f"s{k}") for k, x in enumerate(score)], *sums)
        score = [c(f"s{k}") for k in range(p)]
        sums = [F.sum(k).alias(k) for k in ("rr", "n", "sw", "sy", "syy")]
    meat = [F.sum(score[i] * score[j]).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)]
    s = rows.agg(*meat, *sums, F.count("*").alias("groups")).first()
    g, n = s["groups"], s["n"]
    factor = g / (g - 1) * (n - 1) / (n - p) if cluster else n / (n - p)
    m = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = s[f"m{i}_{j}"]
    bread = np.linalg.pinv(xx)
    cov = factor * bread @ m @ bread
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    return {"names": ["intercept", *xs], "beta": beta, "cov": cov, "se": se, "mde": DETECTABLE * se, "n": int(n), "r2": 1 - s["rr"] / (s["syy"] - s["sy"] ** 2 / s["sw"])}


def wald(fit: dict, names: list[str]) -> tuple[float, int, float]:
    """Joint test that these coefficients are 0: the statistic, its degrees of freedom, and the chance of a larger one."""
    at = [fit["names"].index(n) for n in names]
    b = fit["beta"][at]
    w = float(b @ np.linalg.pinv(fit["cov"][np.ix_(at, at)]) @ b)
    k, p = (1, math.erfc(math.sqrt(w / 2))) if len(at) % 2 else (2, math.exp(-w / 2))
    while k < len(at):  # two degrees of freedom more
        p += math.exp(k / 2 * math.log(w / 2) - w / 2 - math.lgamma(k / 2 + 1)) if w > 0 else 0.0
        k += 2
    return w, len(at), p


def spline_basis(x: Column, knots: list[float]) -> list[Column]:
    """Restricted cubic spline: len(knots) - 2 columns beside x itself, linear beyond the outer knots."""
    t = sorted(set(knots))
    if len(t) < 3:
        raise ValueError(f"a restricted cubic spline needs 3 distinct knots at least, got {t}")
    cube = lambda k: F.pow(F.greatest(x - F.lit(float(k)), F.lit(0.0)), 3)
    last, before = t[-1], t[-2]
    return [(cube(k) - cube(before) * ((last - k) / (last - before)) + cube(last) * ((before - k) / (last - before))) / (last - t[0]) ** 2 for k in t[:-2]]


def average_ranks(df: DataFrame, value: str, out: str, ranges: int = 64) -> DataFrame:
    """df with the rank of a column from 1, ties at their mean. Values are counted, summed up within ranges and
    after the sums of the ranges before, so no task orders all rows. Null values have no rank."""
    counts = df.where(c(value).isNotNull()).groupBy(c(value).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = sorted(set(counts.approxQuantile("_v", [k / ranges for k in range(1, ranges)], 0.005)))
    counts = counts.withColumn("_range", F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda x: x <= c("_v"))))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("_range").agg(F.sum("_n").alias("_s")).select("_range", F.coalesce(F.sum("_s").over(until(Window.orderBy("_range"))), F.lit(0)).alias("_far"))  # a row a range
    within = F.coalesce(F.sum("_n").over(until(Window.partitionBy("_range").orderBy("_v"))), F.lit(0))
    ranks = counts.withColumn("_near", within).join(F.broadcast(sums), "_range").select("_v", (c("_far") + c("_near") + (c("_n") + 1) / 2).alias(out))
    return df.join(ranks, c(value) == c("_v"), "left").drop("_v")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of its own where a single process runs everything."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = sc.getConf().get("spark.checkpoint.dir", None)
        if not base and (not sc.master.startswith("local") or sc.master.startswith("local-")):  # one process may do without
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="swerve-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder that the cluster names: later steps neither recompute it nor plan it again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in that folder, read again: computed once, pruned by later reads, and of known size, so a join may
    broadcast it where it is small."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quantile_fits(df: DataFrame, models: dict[str, tuple[list[str], Column]], y: str, tau: float, rounds: int = 25, eps: float = 1e-3) -> dict[str, np.ndarray]:
    """Coefficients of a conditional quantile for each model (columns, and which rows teach it), by iteratively
    reweighted least squares. A round is one aggregation for all models."""
    beta: dict[str, np.ndarray] = {}
    for _ in range(rounds + 1):
        sums = []
        for name, (xs, taught) in models.items():
            cols = [F.lit(1.0), *[c(x).cast("double") for x in xs], c(y).cast("double")]
            w = F.lit(1.0)
            if name in beta:
                r = c(y) - linear(xs, beta[name])
                w = F.when(r >= 0, tau).otherwise(1 - tau) / F.greatest(F.abs(r), F.lit(eps))
            w = F.when(taught & c(y).isNotNull(), w)
            sums += [F.sum(w * cols[i] * cols[j]).alias(f"{name}:g{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
        row, moved = df.agg(*sums).first().asDict(), 0.0
        for name, (xs, _) in models.items():
            own = {k.split(":")[1]: v for k, v in row.items() if k.startswith(f"{name}:")}
            new = solve(*unpack(own, len(xs) + 1)[:2])
            moved = max(moved, float(np.abs(new - beta[name]).max() / (1 + np.abs(beta[name]).max())) if name in beta else 1.0)
            beta[name] = new
        if moved < 1e-6:
            break
    return beta


#: Rows of a key that are held in one row of arrays at most.
PACKED_ROWS = 1024


def _packed(cols: list[str]):
    """Batches of rows ordered by key, to rows of a key and arrays of its values, of PACKED_ROWS at most."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = batch.column("_key"), batch.num_rows
            begins = np.append(0, np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1)
            ends = np.append(begins[1:], n)
            cuts = np.concatenate([np.arange(i, j, PACKED_ROWS) for i, j in zip(begins, ends, strict=True)])
            offsets = pa.array(np.append(cuts, n), pa.int32())
            yield pa.RecordBatch.from_arrays([key.take(pa.array(cuts)), *[pa.ListArray.from_arrays(offsets, batch.column(k)) for k in cols]], names=["_key", *cols])

    return run


def _reweighed(xs: list[str], y: str, beta: np.ndarray, tau: float, eps: float, lam: float):
    """Batches of packed rows, each with its key's sums of the round before (g0_j; null at first), to cross products weighted by
    the residuals, summed by key within the batch."""
    p = len(xs) + 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            read = lambda k: batch.column(k).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            sizes = pc.list_value_length(batch.column(y)).to_numpy()
            begins = np.cumsum(sizes) - sizes
            x, v = [pc.list_flatten(batch.column(k)).to_numpy() for k in xs], pc.list_flatten(batch.column(y)).to_numpy()
            left = sum(float(b) * read(f"g0_{k}") for k, b in enumerate(beta))
            u = np.nan_to_num((read(f"g0_{p}") - left) / (read("g0_0") + lam))
            r = v - float(beta[0]) - np.repeat(u, sizes)
            for b, k in zip(beta[1:], x, strict=True):
                r -= float(b) * k
            w = np.where(r > 0, tau, 1 - tau) / np.maximum(np.abs(r), eps)
            cols, sums = [None, *x, v], {}
            for i in range(p + 1):
                part = w * cols[i] if i else w
                for j in range(i, p + 1):
                    sums[f"g{i}_{j}"] = np.add.reduceat(part * cols[j] if j else part, begins)
            by_key = pa.table({"_key": batch.column("_key"), **sums}).group_by("_key").aggregate([(k, "sum") for k in sums])
            yield from by_key.select(["_key", *[f"{k}_sum" for k in sums]]).rename_columns(["_key", *sums]).to_batches()

    return run


def quantile_regression(df: DataFrame, xs: list[str], y: str, key: str, tau: float, tau2: float, rounds: int = 40, eps: float = 1e-3) -> tuple[np.ndarray, DataFrame]:
    """(coefficients, (key, u)): a conditional quantile with a random intercept u of variance tau2 per key.

    Each round weighs rows by their residuals, sums cross products per key, eliminates the intercepts from the normal
    equations, solves for the few coefficients on the driver and gives every key its intercept, shrunk by 1 / tau2.
    Rows are shuffled by key, packed into arrays and kept once; a round reads them where they are and only sums, a
    row a key, are shuffled to them. Nothing of the size of the keys leaves the executors; a round's sums are written, so
    that no round depends on the plan of the one before. Ends when no coefficient moves by more than a millionth. Rows with a null
    key, value or column take no part.
    """
    p, lam, spark = len(xs) + 1, 1.0 / tau2, df.sparkSession
    rows = df.select(c(key).alias("_key"), *[c(x).cast("double").alias(x) for x in xs], c(y).cast("double").alias(y)).dropna()
    names = [f"g{i}_{j}" for i in range(p + 1) for j in range(i, p + 1)]
    arrays = T.StructType([rows.schema["_key"], *[T.StructField(k, T.ArrayType(T.DoubleType())) for k in (*xs, y)]])
    out = T.StructType([rows.schema["_key"], *[T.StructField(k, T.DoubleType()) for k in names]])
    g = lambda i, j: c(f"g{i}_{j}")
    own = [f"g0_{j}" for j in range(p + 1)]
    d = g(0, 0) + lam
    less = [F.sum(g(i, j) - g(0, i) * g(0, j) / d).alias(f"g{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.repartition(parts, "_key").sortWithinPartitions("_key").mapInArrow(_packed([*xs, y]), arrays).repartition(parts, "_key").persist()
    beta, sums = solve(*unpack(gram(rows, xs, y).first(), p)[:2]), None
    try:
        for _ in range(rounds):
            known = packed.join(sums.select("_key", *own).hint("shuffle_hash"), "_key") if sums is not None else packed.withColumns({k: F.lit(None).cast("double") for k in own})
            sums = stored(known.mapInArrow(_reweighed(xs, y, beta, tau, eps, lam), out).groupBy("_key").agg(*[F.sum(k).alias(k) for k in names]))
            new = solve(*unpack(sums.agg(*less).first(), p)[:2])
            done = float(np.abs(new - beta).max()) < 1e-6 * (1 + float(np.abs(beta).max()))
            beta = new
            if done:
                break
    finally:
        packed.unpersist()
    return beta, sums.select(c("_key").alias(key), ((g(0, p) - sum((g(0, k) * float(b) for k, b in enumerate(beta)), F.lit(0.0))) / d).alias("u"))


def quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], ranges: int = 64) -> DataFrame:
    """by and q0, q1, ...: exact quantiles, interpolated between neighbours. Values are counted, and the place of
    each is known from the sums of the ranges before and of the smaller values in its own, so no group
    is held in one buffer or ordered in one task."""
    counts = df.where(c(value).isNotNull()).groupBy(*by, c(value).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = sorted(set(counts.approxQuantile("_v", [k / ranges for k in range(1, ranges)], 0.005)))
    counts = counts.withColumn("_range", F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda x: x <= c("_v"))))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_s"))
    far = F.coalesce(F.sum("_s").over(until(Window.partitionBy(*by).orderBy("_range"))), F.lit(0))
    sums = sums.select(*by, "_range", far.alias("_far"), F.sum("_s").over(Window.partitionBy(*by)).alias("_total"))
    near = F.coalesce(F.sum("_n").over(until(Window.partitionBy(*by, "_range").orderBy("_v"))), F.lit(0))
    placed = counts.withColumn("_near", near).join(sums, [*by, "_range"]).withColumn("_at", c("_far") + c("_near"))
    pick = lambda k: F.max(F.when((c("_at") <= k) & (k < c("_at") + c("_n")), c("_v")))
    place = lambda q: F.lit(q) * (c("_total") - 1)
    wide = placed.groupBy(*by).agg(F.first("_total").alias("_total"), *[e for i, q in enumerate(qs) for e in (pick(F.floor(place(q))).alias(f"_l{i}"), pick(F.ceil(place(q))).alias(f"_h{i}"))])
    return wide.select(*by, *[(c(f"_l{i}") + (c(f"_h{i}") - c(f"_l{i}")) * (place(q) - F.floor(place(q)))).alias(f"q{i}") for i, q in enumerate(qs)])


#: Rows of a block that a task holds with their ranks of all permutations; longer blocks are ranked by Spark.
BLOCK_ROWS = 1 << 17


def _permuted(block: str, x: str, y: str, reps: int, means: tuple[float, float]):
    """Batches ordered by block and key, to moments of x and y by permutation: rep 0 as it is, others with y dealt within
    the block in the order of the hash h<rep>. Holds the blocks of a batch, and one that goes on in the next."""

    def moments(table: pa.Table) -> np.ndarray:
        read = lambda k: table.column(k).to_numpy()
        code = read(block)
        u, v = (np.asarray(read(k), float) - m for k, m in ((x, means[0]), (y, means[1])))
        known = (table.column(k).is_valid().to_numpy() for k in (x, y))
        ku, kv = known
        u, v, out = np.where(ku, u, 0.0), np.where(kv, v, 0.0), np.zeros((reps + 1, 6))
        for rep in range(reps + 1):
            at = np.lexsort((read(f"h{rep}"), code)) if rep else np.arange(len(u))
            a, b = u * kv[at], v[at] * ku
            out[rep] = (ku & kv[at]).sum(), a.sum(), b.sum(), a @ u, b @ v[at], u @ v[at]
        return out

    def run(batches):
        total, held, last = np.zeros((reps + 1, 6)), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(block).to_numpy()
            if code[-1] != last:  # the blocks before the last one are whole
                cut = int(np.searchsorted(code, code[-1]))
                done = [*held, *([batch.slice(0, cut)] if cut else [])]
                if done:
                    total += moments(pa.Table.from_batches(done))
                held, last, batch = [], code[-1], batch.slice(cut)
            held.append(batch)
        if held:
            total += moments(pa.Table.from_batches(held))
        yield pa.RecordBatch.from_arrays([pa.array(range(reps + 1), pa.int32()), *map(pa.array, total.T)], names=["rep", *MOMENTS])

    return run


MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def block_permutations(df: DataFrame, block: str, key: list[str], x: str, y: str, reps: int, seed: int) -> DataFrame:
    """(rep, r): the correlation of x and y, as it is in rep 0 and with y dealt anew within each block by hashes of the
    keys in the others.

    Rows are shuffled and ordered once; a task takes all permutations of a block at a time. Blocks of more than
    BLOCK_ROWS rows are ranked by windows instead, which repeats their rows for each permutation. Rows with a null block take no part.
    """
    df = df.where(c(block).isNotNull())
    shuffle = lambda rep: F.xxhash64(F.lit(seed), rep, *key)
    means = df.agg(F.avg(F.when(~F.isnan(x), c(x).cast("double"))), F.avg(F.when(~F.isnan(y), c(y).cast("double")))).first()
    means = tuple(m or 0.0 for m in means)
    long = [r[0] for r in df.groupBy(block).count().where(c("count") > BLOCK_ROWS).collect()]  # fewer than rows / BLOCK_ROWS
    rest = df.where(~c(block).isin(long)) if long else df
    rest = rest.repartition(block).sortWithinPartitions(block, *key)
    rest = rest.select(block, c(x).cast("double").alias(x), c(y).cast("double").alias(y), *[shuffle(F.lit(rep)).alias(f"h{rep}") for rep in range(1, reps + 1)])
    sums = rest.mapInArrow(_permuted(block, x, y, reps, means), "rep int, " + ", ".join(f"{k} double" for k in MOMENTS))
    if long:
        one = df.where(c(block).isin(long)).withColumn("_i", F.row_number().over(Window.partitionBy(block).orderBy(*key)))
        each = one.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
        order = Window.partitionBy("rep", block).orderBy(F.when(c("rep") == 0, c("_i").cast("long")).otherwise(shuffle(c("rep"))), *key)
        dealt = each.select("rep", block, c(y).cast("double").alias("_y"), F.row_number().over(order).alias("_i"))
        u, v = c(x).cast("double") - means[0], c("_y") - means[1]
        both = each.select("rep", block, "_i", x).join(dealt, ["rep", block, "_i"]).where(c(x).isNotNull() & c("_y").isNotNull())
        sums = sums.union(both.groupBy("rep").agg(*[F.sum(e).alias(k) for k, e in zip(MOMENTS, (F.lit(1.0), u, v, u * u, v * v, u * v), strict=True)]))
    g = sums.groupBy("rep").agg(*[F.sum(k).alias(k) for k in MOMENTS])
    spread = lambda k: c(f"s{k}{k}") - c(f"s{k}") * c(f"s{k}") / c("n")
    return g.where("n > 0").select("rep", F.try_divide(c("sxy") - c("sx") * c("sy") / c("n"), F.sqrt(spread("x") * spread("y"))).alias("r"))


def pinball(residual: Column, tau: float) -> Column:
    return F.greatest(tau * residual, (tau - 1) * residual)


#: Rows of a range of times or risks, and ranges at most.
RANGE_ROWS, RANGES = 250_000, 256


def _later(node: np.ndarray, t: np.ndarray, n: np.ndarray, e: np.ndarray) -> int:
    """Sum of e times the n of later times in the same node; t falls from row to row."""
    order = np.argsort(node, kind="stable")
    node, t, n = node[order], t[order], n[order]
    before, place = np.cumsum(n) - n, np.arange(len(n))
    new = np.append(True, node[1:] != node[:-1])
    start, at = (np.maximum.accumulate(np.where(x, place, 0)) for x in (new, new | np.append(True, t[1:] != t[:-1])))
    return int(((before[at] - before[start]) * e[order]).sum())


def concordant(t: np.ndarray, v: np.ndarray, n: np.ndarray, e: np.ndarray) -> tuple[int, int, int]:
    """(pairs, higher, tied) of e events and n rows at each time t and risk v: an event, and a row of a later time; higher:
    of lower risk. Risks below one's own are the left siblings of its bits."""
    if not len(t):
        return 0, 0, 0
    t, v = (np.unique(x, return_inverse=True)[1] for x in (t, v))
    order = np.argsort(-t, kind="stable")
    t, v, n, e = t[order], v[order], n[order], e[order]
    bits = int(v.max()).bit_length()
    higher = sum(_later(v >> (b + 1), t, n * (~v >> b & 1), e * (v >> b & 1)) for b in range(bits))
    return _later(np.zeros_like(v), t, n, e), higher, _later(v, t, n, e)


def _placed(cuts: list[np.ndarray]):
    """Batches of (t, v, e) with the ranges of t and v: odd for a cut itself, even between cuts."""

    def run(batches):
        for batch in batches:
            at = []
            for k, own in zip("tv", cuts, strict=True):
                x = batch.column(k).to_numpy()
                left = np.searchsorted(own, x)
                at.append(pa.array(2 * left + (np.append(own, np.nan)[left] == x), pa.int32()))
            yield pa.RecordBatch.from_arrays([*at, *(batch.column(k) for k in "tve")], names=["tb", "vb", "t", "v", "e"])

    return run


def _counted(time: str, group: str):
    """A group of rows to its counts of concordant."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda k: table.column(k).to_numpy()
        pairs, higher, tied = concordant(read(time), read("v"), read("n"), read("e"))
        return pa.table({"pairs": [pairs if group == "tb" else 0], "higher": [higher], "tied": [tied]})

    return run


def concordance(df: DataFrame, time: str, risk: str, event: str, ranges: int | None = None) -> DataFrame:
    """(pairs, higher, tied) over all pairs of rows: an event, and a row of a later time.

    Times and risks are cut into ranges by quantiles, of about RANGE_ROWS rows but no more than RANGES; a cut is a range of its own, so a
    frequent value shares none. Pairs within a range of times are counted there, pairs of different ranges of times within a
    range of risks by that range's counts, all others from the counts of the cells of both, which alone are collected.
    """
    rows = df.where(c(time).isNotNull() & c(risk).isNotNull()).select(c(time).cast("double").alias("t"), c(risk).cast("double").alias("v"), F.coalesce(c(event).cast("boolean"), F.lit(False)).cast("long").alias("e"))
    k = ranges or min(RANGES, rows.count() // RANGE_ROWS + 1)
    found = rows.approxQuantile(["t", "v"], [i / k for i in range(1, k)] or [0.5], 1 / (4 * k))
    cuts = [np.array(sorted(set(q))) for q in found]
    placed = rows.mapInArrow(_placed(cuts), "tb int, vb int, t double, v double, e long")
    counts = stored(placed.groupBy("tb", "vb", "v").agg(F.count("*").alias("n"), F.sum("e").alias("e")))
    out = "pairs long, higher long, tied long"
    near = placed.where("tb % 2 = 0").withColumn("n", F.lit(1).cast("long")).groupBy("tb").applyInArrow(_counted("t", "tb"), out)
    far = counts.groupBy("vb").applyInArrow(_counted("tb", "vb"), out)
    n, e = np.zeros((2, *(2 * len(q) + 1 for q in cuts)), np.int64)
    for r in counts.groupBy("tb", "vb").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).collect():
        n[r["tb"], r["vb"]], e[r["tb"], r["vb"]] = r["n"], r["e"]
    later = n[::-1].cumsum(0)[::-1] - n
    lower = later.cumsum(1) - later
    rest = {"pairs": int((e.sum(1) * later.sum(1)).sum()), "higher": int((e * lower).sum()), "tied": 0}
    return near.union(far).agg(*[(F.coalesce(F.sum(k), F.lit(0)) + F.lit(v).cast("long")).alias(k) for k, v in rest.items()])
