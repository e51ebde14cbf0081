"""Replicates, wild bootstrap and splines against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swerve.operators import replicates as B
from swerve.operators import stats as S


@pytest.mark.parametrize("kind", ["poisson", "exponential", "sign"])
def test_replicate_sums(spark, kind):
    r = np.random.default_rng(3)
    rows = [(int(k), int(g), float(v), None if v > 0.9 else 1.0) for k, g, v in zip(r.integers(0, 700, 3000), r.integers(0, 3, 3000), r.random(3000))] + [(None, 1, 5.0, 1.0)]
    got = B.replicate_sums(spark.createDataFrame(rows, "k long, g int, v double, n double").repartition(3), "k", ["v", "n"], 300, 5, kind, "g", 3).toPandas()
    keys = np.arange(700)
    w = B.weights(keys, 300, 5, kind)
    want = np.zeros((3, 300, 2))
    for k, g, v, n in rows[:-1]:
        want[g, :, 0] += w[k] * v
        want[g, :, 1] += w[k] * (n or 0)
    assert np.allclose(got.sort_values(["g", "rep"])[["v", "n"]].to_numpy().reshape(3, 300, 2), want)
    mean, var = {"poisson": (1, 1), "exponential": (1, 1), "sign": (0, 1)}[kind]
    assert abs(w.mean() - mean) < 0.02 and abs(w.var() - var) < 0.05
    assert abs(np.corrcoef(w)[np.triu_indices(700, 1)]).mean() < 0.1 and abs(np.corrcoef(w.T)[np.triu_indices(300, 1)]).mean() < 0.1


@pytest.mark.parametrize("bins, q", [(16, 0.5), (64, 0.9), (4096, 0.25)])
def test_replicate_quantile(spark, bins, q):
    """Few bins make several passes; the values are continuous, with one that is a third of all."""
    r = np.random.default_rng(bins)
    keys = r.integers(0, 60, 900)
    values = np.where(r.random(900) < 0.33, 0.25, r.normal(keys / 30, 1))
    rows = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values)] + [(None, 1.0), (3, None)], "k long, v double")
    got = B.replicate_quantile(rows, "k", "v", q, 100, 9, bins)
    w = B.weights(np.arange(60), 100, 9, "poisson").astype(int)
    want = [np.quantile(np.repeat(values, w[keys, rep]), q) for rep in range(100)]
    assert np.allclose(got, want)
    assert np.isnan(B.replicate_quantile(rows.limit(0), "k", "v", q, 10, 9)).all()


def planted(n_clusters, slope, seed=1):
    r = np.random.default_rng(seed)
    g = np.sort(r.integers(0, n_clusters, 600))
    x, z = r.normal(g % 3, 1), r.normal(0, 1, 600)
    return g, x, z, 1 + slope * x + 0.5 * z + r.normal(0, 1, n_clusters)[g] + r.normal(0, 1, 600)


def cluster_t(X, y, g, k):
    bread = np.linalg.pinv(X.T @ X)
    b = bread @ X.T @ y
    e = y - X @ b
    s = np.array([X[g == c].T @ e[g == c] for c in np.unique(g)])
    n, p, m = len(y), X.shape[1], len(s)
    return b[k] / math.sqrt((m / (m - 1) * (n - 1) / (n - p) * bread @ (s.T @ s) @ bread)[k, k])


@pytest.mark.parametrize("slope", [0.0, 1.5])
def test_wild_cluster(spark, slope):
    g, x, z, y = planted(12, slope)
    rows = spark.createDataFrame([tuple(map(float, v)) for v in zip(g, x, z, y)], "g double, x double, z double, y double").withColumn("g", F.col("g").cast("long"))
    got = B.wild_cluster(rows, ["z", "x"], "y", "x", "g", 299, 4)
    X = np.column_stack([np.ones(600), z, x])
    null = X[:, :2] @ np.linalg.lstsq(X[:, :2], y, rcond=None)[0]
    signs = B.weights(np.arange(12), 299, 4, "sign")
    t = np.array([abs(cluster_t(X, null + signs[g, rep] * (y - null), g, 2)) for rep in range(299)])
    seen = abs(cluster_t(X, y, g, 2))
    assert np.allclose(got["replicates"], t) and math.isclose(got["t"], seen)
    assert math.isclose(got["p"], ((t >= seen * (1 - 1e-9)).sum() + 1) / 300) and 0 < got["p"] <= 1
    assert (got["p"] < 0.05) == (slope > 0)


def test_spline_and_wald(spark):
    r = np.random.default_rng(8)
    x = r.uniform(0, 50, 500)
    knots = [3.0, 15.0, 30.0, 47.0]
    basis = [c.alias(f"s{k}") for k, c in enumerate(S.spline_basis(F.col("x"), knots))]
    b = spark.createDataFrame([(float(v),) for v in np.append(x, [-9, 60, 70, 80])], "x double").select("x", *basis).toPandas().sort_values("x")
    assert (b[b.x <= 3][["s0", "s1"]] == 0).all().all()
    tail = b[b.x >= 60]
    assert np.allclose(np.diff(tail[["s0", "s1"]].to_numpy(), 2, axis=0), 0)  # linear beyond the last knot
    with pytest.raises(ValueError):
        S.spline_basis(F.col("x"), [1.0, 1.0, 2.0])
    for bend in (0.0, 0.004):
        rows = spark.createDataFrame([(float(v), float(2 * v + bend * v**2 + e), k % 40) for k, (v, e) in enumerate(zip(x, r.normal(0, 1, 500)))], "x double, y double, g int").select("*", *basis)
        w, k, p = S.wald(S.ols(rows, ["x", "s0", "s1"], "y", "g"), ["s0", "s1"])
        assert k == 2 and math.isclose(p, math.exp(-w / 2)) and (p < 0.001) == (bend > 0)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6])
def test_wald_tail(k):
    """The upper tail of a chi-squared variable, by sampling."""
    fit = {"names": list(range(k)), "beta": np.full(k, 1.3), "cov": np.eye(k)}
    w, _, p = S.wald(fit, list(range(k)))
    sample = (np.random.default_rng(k).normal(size=(200000, k)) ** 2).sum(axis=1)
    assert abs((sample >= w).mean() - p) < 0.005
