"""Replicates of statistics over groups: weights by a hash of group and replicate, sums for all replicates in one pass.

A task holds the sums of its rows for every replicate, so what is shuffled is one set of sums per task and not a row per group
and replicate. A group's weight in a replicate is a function of the two, so groups need no numbers and no order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
MASK = 0xFFFFFFFF
#: Shares of a Poisson variable of mean 1 that are at most 0, 1, ...; beyond twelve lies less than 1e-9.
POISSON = [float(x) for x in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])]
#: Replicates of a shuffled row, and groups whose weights are held at once.
BLOCK, KEYS = 250, 512
#: A replicate whose signs are all alike repeats the data; its statistic counts as equal whatever the last bits.
SAME = 1 - 1e-9


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 32 bits, in 64-bit integers."""
    x = (x ^ (x >> np.uint64(16))) * np.uint64(2246822507) & np.uint64(MASK)
    x = (x ^ (x >> np.uint64(13))) * np.uint64(3266489909) & np.uint64(MASK)
    return x ^ (x >> np.uint64(16))


def weights(keys: np.ndarray, reps: int, seed: int, kind: str) -> np.ndarray:
    """(groups, replicates): 'poisson' counts of draws with replacement, 'exponential' weights, or 'sign' of -1 or 1."""
    own = _mixed(((keys.astype(np.int64).view(np.uint64) & np.uint64(MASK)) * np.uint64(2654435761) + np.uint64(seed)) & np.uint64(MASK))
    h = _mixed((own[:, None] + np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(2246822519)) & np.uint64(MASK))
    if kind == "sign":
        return np.where(h < 1 << 31, -1.0, 1.0)
    u = (h + 0.5) / 4294967296.0
    return -np.log(u) if kind == "exponential" else np.searchsorted(POISSON, u, "right").astype(float)


def weights_sql(groups: str, key: str, reps: int, seed: int, kind: str) -> str:
    """The same as a query of (rep, key, w); groups is a relation with the distinct keys, none below 0."""
    mixed = lambda x: f"list_transform(list_transform(list_transform([{x}], lambda v: xor(v, v >> 16) * 2246822507::UBIGINT % 4294967296::UBIGINT), lambda v: xor(v, v >> 13) * 3266489909::UBIGINT % 4294967296::UBIGINT), lambda v: xor(v, v >> 16))[1]"
    own = mixed(f"(({key}::UBIGINT % 4294967296::UBIGINT) * 2654435761::UBIGINT + {seed}::UBIGINT) % 4294967296::UBIGINT")
    h = mixed("(own + (rep + 1)::UBIGINT * 2246822519::UBIGINT) % 4294967296::UBIGINT")
    w = {"sign": "CASE WHEN h < 2147483648 THEN -1.0::DOUBLE ELSE 1.0 END", "exponential": "-ln((h + 0.5) / 4294967296.0::DOUBLE)", "poisson": " + ".join(f"((h + 0.5) / 4294967296.0::DOUBLE >= {t!r}::DOUBLE)::INT" for t in POISSON)}[kind]
    return f"SELECT rep, {key}, {w} AS w FROM (SELECT rep, {key}, {h} AS h FROM (SELECT {key}, {own} AS own FROM {groups}), (SELECT unnest(range({reps})) AS rep))"


def _partial(columns: list[str], reps: int, seed: int, kind: str, groups: int):
    names = ["g", "block", *columns]

    def run(batches):
        sums = np.zeros((groups, len(columns), reps))
        for batch in batches:
            keys, at = np.unique(batch.column("k").to_numpy(), return_inverse=True)
            group = batch.column("g").to_numpy()
            values = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in columns])
            for lo in range(0, len(keys), KEYS):
                some = (at >= lo) & (at < lo + KEYS)
                own, n = weights(keys[lo : lo + KEYS], reps, seed, kind), min(KEYS, len(keys) - lo)
                cells, where = np.unique(group[some], return_inverse=True)
                flat = where * n + at[some] - lo
                for j, v in enumerate(values):
                    sums[cells, j] += np.bincount(flat, v[some], len(cells) * n).reshape(len(cells), n) @ own
        found = np.flatnonzero(np.abs(sums).sum(axis=(1, 2)))
        for lo in range(0, reps, BLOCK):
            part = sums[found, :, lo : lo + BLOCK]
            offsets = np.arange(len(found) + 1, dtype=np.int32) * part.shape[2]
            arrays = [pa.ListArray.from_arrays(offsets, np.ascontiguousarray(part[:, j]).ravel()) for j in range(len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), lo // BLOCK), pa.int32()), *arrays], names=names)

    return run


def _total(columns: list[str], reps: int):
    names = ["g", "rep", *columns]

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lists = [batch.column(x) for x in columns]
            for i, at in enumerate(zip(batch.column("g").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                one = np.stack([x[i].values.to_numpy() for x in lists])
                sums[at] = sums[at] + one if at in sums else one
        for (g, block), one in sums.items():
            n = one.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g), pa.int32()), pa.array(np.arange(block * BLOCK, block * BLOCK + n), pa.int32()), *map(pa.array, one)], names=names)

    return run


def replicate_sums(rows: DataFrame, key: str, columns: list[str], reps: int, seed: int, kind: str = "poisson", by: str | None = None, groups: int = 1) -> DataFrame:
    """(by, rep, columns): the sums of w * column over rows, where w is the weight of the row's key in the replicate.

    key is an integer column. by is an integer column from 0 to groups - 1, of few values: a task holds groups x columns x reps sums.
    Rows with a null key are left out, null values count as 0. Sums that are 0 in all replicates may be left out.
    """
    source = rows.where(c(key).isNotNull()).select(c(key).cast("long").alias("k"), (c(by) if by else F.lit(0)).cast("int").alias("g"), *[F.coalesce(c(x).cast("double"), F.lit(0.0)).alias(x) for x in columns])
    part = source.mapInArrow(_partial(columns, reps, seed, kind, groups), "g int, block int, " + ", ".join(f"{x} array<double>" for x in columns))
    out = part.repartition("g", "block").mapInArrow(_total(columns, reps), "g int, rep int, " + ", ".join(f"{x} double" for x in columns))
    return out.withColumnRenamed("g", by) if by else out.drop("g")


def replicate_quantile(rows: DataFrame, key: str, value: str, q: float, reps: int, seed: int, bins: int = 1024) -> np.ndarray:
    """The exact quantile of value in each replicate of a Poisson bootstrap of keys, interpolated between neighbours.

    Rows are counted by key and bin, and weighted for all replicates at once. The bins in which a replicate's
    quantile lies are cut again, with the weights below them carried on, until each holds one value. The driver gets bins x reps
    sums a pass. NaN where a replicate draws no row; an empty table gives NaN throughout.
    """
    rows = rows.where(c(key).isNotNull() & c(value).isNotNull()).select(c(key).alias("_k"), c(value).cast("double").alias("_v"))
    here, below, total, span = rows, np.zeros(reps), None, (None, None)
    while True:
        seen = [r["_v"] for r in here.select("_v").distinct().limit(bins + 1).collect()]
        exact = len(seen) <= bins
        cuts = sorted(seen) if exact else sorted(set(here.approxQuantile("_v", [k / bins for k in range(1, bins)], 0.2 / bins)))
        if not cuts:
            return np.full(reps, np.nan)
        placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_v", outputCol="_b").transform(here)
        counts = placed.groupBy("_k", c("_b").cast("int").alias("_b")).agg(F.count("*").alias("n"))
        sums, table = np.zeros((len(cuts) + 1, reps)), replicate_sums(counts, "_k", ["n"], reps, seed, by="_b", groups=len(cuts) + 1).toArrow()
        sums[table["_b"].to_numpy(), table["rep"].to_numpy()] = table["n"].to_numpy()
        until = below + np.cumsum(sums, axis=0)
        if total is None:
            total = until[-1]
            place = q * (total - 1)
        low, high = ((until > np.maximum(p, 0)).argmax(axis=0) for p in (np.floor(place), np.ceil(place)))
        if exact:
            v = np.array([np.nan, *cuts])
            return np.where(total > 0, v[low] + (v[high] - v[low]) * (place - np.floor(place)), np.nan)
        first, last = int(low[total > 0].min(initial=len(cuts))), int(high[total > 0].max(initial=0))
        new = (cuts[first - 1] if first > 0 else span[0], cuts[last] if last < len(cuts) else span[1])
        if new == span:  # nothing is left out: cut finer
            bins *= 4
            continue
        if first > 0:
            here, below = here.where(c("_v") >= new[0]), until[first - 1]
        if last < len(cuts):
            here = here.where(c("_v") < new[1])
        span = new


def wild_cluster(rows: DataFrame, xs: list[str], y: str, tested: str, cluster: str, reps: int, seed: int) -> dict:
    """Restricted wild bootstrap of a coefficient's t statistic with CR1 errors by cluster.

    The residuals of the fit without the tested column get a sign per cluster. A replicate's coefficients are linear in the
    signs, and its variance is a quadratic form: with q = a's and r = M a of a cluster (s its scores, M its cross products, a the
    tested row of the inverse of all cross products) and d the replicate's coefficients, sum q q - 2 d' sum w q r + d' (sum r r') d. So rows are read for cross
    products and for scores only. p is (as extreme + 1) / (reps + 1). The CR1 factor is the same on both sides.
    """
    from .stats import gram, linear, ols, settled, solve, unpack

    k, p = xs.index(tested) + 1, len(xs) + 1
    rows = rows.where(c(y).isNotNull() & c(cluster).isNotNull())
    full = ols(rows, xs, y, cluster)
    others = [x for x in xs if x != tested]
    null = solve(*unpack(gram(rows, others, y).first(), p - 1)[:2])
    sums = settled(gram(rows.withColumn("_e", c(y) - linear(others, null)), xs, "_e", [cluster]))
    g = lambda i, j: c(f"g{min(i, j)}_{max(i, j)}")
    xx = unpack(sums.agg(*[F.sum(g(i, j)).alias(f"g{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]).first(), p)[0]
    inverse = np.linalg.pinv(xx)
    dot = lambda of: sum((F.lit(float(inverse[k, j])) * of(j) for j in range(p)), F.lit(0.0))
    one = sums.select(cluster, *[g(i, p).alias(f"s{i}") for i in range(p)], dot(lambda j: g(j, p)).alias("q"), *[dot(lambda j, i=i: g(i, j)).alias(f"r{i}") for i in range(p)])
    one = one.withColumns({f"c{i}": c("q") * c(f"r{i}") for i in range(p)})
    fixed = one.agg(F.sum(c("q") * c("q")).alias("qq"), F.count("*").alias("n"), *[F.sum(c(f"r{i}") * c(f"r{j}")).alias(f"r{i}_{j}") for i in range(p) for j in range(p)]).first()
    rr = np.array([[fixed[f"r{i}_{j}"] for j in range(p)] for i in range(p)])
    drawn = replicate_sums(one, cluster, [f"s{i}" for i in range(p)] + [f"c{i}" for i in range(p)], reps, seed, "sign").orderBy("rep").toPandas()
    d = drawn[[f"s{i}" for i in range(p)]].to_numpy() @ inverse
    variance = fixed["qq"] - 2 * (d * drawn[[f"c{i}" for i in range(p)]].to_numpy()).sum(axis=1) + np.einsum("ri,ij,rj->r", d, rr, d)
    n, groups = full["n"], fixed["n"]
    factor = groups / (groups - 1) * (n - 1) / (n - p)
    t = np.divide(np.abs(d[:, k]), np.sqrt(np.maximum(factor * variance, 0)), out=np.zeros(len(d)), where=variance > 0)
    seen = float(abs(full["beta"][k] / full["se"][k]))
    return {"estimate": float(full["beta"][k]), "se": float(full["se"][k]), "t": seen, "p": (int((t >= seen * SAME).sum()) + 1) / (reps + 1), "reps": reps, "clusters": int(groups), "replicates": t}
