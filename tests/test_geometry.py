"""Centres, scores of events and exponential fits against plain numpy."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swerve.operators import geometry as G
from swerve.operators import tracks as T


def brute_centres(p, k, cell, apart):
    x0, y0 = p.min(0) - cell
    at = lambda g: (x0 + (g[0] + 0.5) * cell, y0 + (g[1] + 0.5) * cell)
    left = sorted(((-n, g) for g, n in Counter((math.floor((x - x0) / cell), math.floor((y - y0) / cell)) for x, y in p).items()))
    seeds = []
    while len(seeds) < k and left:
        far = [g for _, g in left if all(math.dist(at(g), s) >= apart for s in seeds)]
        best = far[0] if far else left[0][1]
        seeds.append(at(best))
        left = [v for v in left if v[1] != best]
    C = np.array(seeds)
    for _ in range(25):
        near = np.linalg.norm(p[:, None] - C[None], axis=2).argmin(1)
        new = np.array([p[near == j].mean(0) if (near == j).any() else C[j] for j in range(len(C))])
        still = np.abs(new - C).max() <= 1e-4
        C = new
        if still:
            break
    return C


def clouds(seed, n=400):
    r = np.random.default_rng(seed)
    mid = np.array([[0, 0], [40, 5], [10, 50], [60, 60]])
    return mid[r.integers(0, 4, n)] + r.normal(0, 4, (n, 2))


@pytest.mark.parametrize("k, apart", [(4, 20.0), (6, 500.0)])
def test_centres(spark, k, apart):
    """Two groups at once and one alone; a separation that nothing keeps still gives k centres."""
    by = {g: clouds(g) for g in (1, 2)}
    rows = spark.createDataFrame([(g, float(x), float(y)) for g, p in by.items() for x, y in p], "g int, x double, y double").repartition(3)
    for groups in ([1, 2], [2]):
        some = rows.where(F.col("g").isin(groups))
        got = G.lloyd(some, "g", G.density_seeds(some, "g", k, 5.0, apart))
        assert sorted(got) == groups
        for g in groups:
            assert np.allclose(got[g], brute_centres(by[g], k, 5.0, apart), atol=1e-6)
    assert G.density_seeds(rows.limit(0), "g", k, 5.0, apart) == {}


def brute_score(events, k, cell, apart, radius):
    half = lambda a: int(hashlib.md5(str(a).encode()).hexdigest()[-1], 16) % 2
    est, ev = [e for e in events if half(e[0]) == 0], [e for e in events if half(e[0]) == 1]
    C = brute_centres(np.array([e[2:4] for e in est]), k, cell, apart)
    out = {"turns_estimate": len(est), "turns_eval": len(ev), "separation": min(math.dist(a, b) for i, a in enumerate(C) for b in C[i + 1 :])}
    for model in ("point", "line"):
        dist = [min((math.dist(e[2:4], c) if model == "point" else abs(e[2] - c[0])) for c in C) for e in ev]
        near = Counter()
        for e, d in zip(ev, dist):
            near[e[0]] += d <= radius
        n = Counter(near.values())
        mode = min(n, key=lambda v: (-n[v], v))
        out |= {f"matched_{model}": sum(near.values()), f"precision_{model}": sum(near.values()) / len(ev), f"expected_{model}": mode, f"recall_{model}": sum(min(v, mode) for v in near.values()) / (mode * len(near)) if mode else 0.0}
    errs = []
    for a in {e[0] for e in ev}:
        seq = []
        for e in sorted((e for e in ev if e[0] == a), key=lambda e: e[1]):
            c = int(np.linalg.norm(C - np.array(e[2:4]), axis=1).argmin())
            if not seq or seq[-1][0] != c:
                seq.append((c, np.array(e[2:4]), abs(e[4])))
        for p, q, s in zip(seq, seq[1:], seq[2:]):
            u, v = q[1] - p[1], s[1] - q[1]
            errs.append(abs(math.degrees(math.acos(max(-1, min(1, u @ v / np.linalg.norm(u) / np.linalg.norm(v))))) - q[2]))
    return out | {"angle_n": len(errs), "angle_error": float(np.median(errs))}


@pytest.mark.parametrize("radius", [6.0, 30.0])
def test_score(spark, radius):
    r, p = np.random.default_rng(2), clouds(7)
    events = [(int(a), i, float(x), float(y), float(r.normal(0, 90))) for i, (a, (x, y)) in enumerate(zip(r.integers(0, 60, 400), p))]
    rows = spark.createDataFrame([("d", *e) for e in events] + [("few", 1, 0, 0.0, 0.0, 1.0)], "d string, a int, i int, x double, y double, angle double")
    got = {x["d"]: x.asDict() for x in G.score_events(rows, "d", "a", ["i"], 4, 5.0, 20.0, radius).collect()}
    for key, v in brute_score(events, 4, 5.0, 20.0, radius).items():
        assert got["d"][key] == pytest.approx(v), key
    assert got["few"]["turns_estimate"] + got["few"]["turns_eval"] == 1 and got["few"]["precision_point"] in (None, 0.0, 1.0)


def test_exponential(spark):
    """Planted constants are found within the last step, those beyond the range lie on its bound, short tracks aren't fitted."""
    taus, finer = [20.0 * 1.25**k for k in range(16)], [[1.25 ** (j / m) for j in range(-8, 9)] for m in (8, 64)]
    truth = {1: 33.3, 2: 100.0, 3: 480.0, 4: 2.0, 5: 9000.0}
    rows = [(k, float(t), 7.0 * (1 - math.exp(-t / tau))) for k, tau in truth.items() for t in range(0, 400, 10)] + [(6, 1.0, 2.0), (6, 2.0, 3.0), *[(7, 0.0, float(j)) for j in range(9)], (8, None, 1.0)]
    got = {r["k"]: r for r in T.fit_exponential(spark.createDataFrame(rows, "k int, t double, v double"), ["k"], "t", "v", taus, finer, 5).collect()}
    for k in (1, 2, 3):
        assert got[k]["tau"] == pytest.approx(truth[k], rel=0.004) and got[k]["vmax"] == pytest.approx(7, rel=0.01) and got[k]["r2"] > 0.9999 and not got[k]["at_lower"] and not got[k]["at_upper"]
        grid = [(sum((v - 7 * (1 - math.exp(-t / tau))) ** 2 for kk, t, v in rows if kk == k), tau) for tau in taus]
        assert got[k]["rmse"] <= math.sqrt(min(grid)[0] / 40) + 1e-9
    assert got[4]["at_lower"] and got[4]["tau"] == 20.0 and got[5]["at_upper"]
    assert [got[k]["found"] for k in (6, 7, 8)] == [False] * 3 and got[8]["tau"] is None
