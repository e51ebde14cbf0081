import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swerve.operators import joins, replicates, stats, tracks, turns


def frames(spark, points):
    return spark.createDataFrame([(1, float(t), float(x), float(y)) for t, x, y in points], "track long, t double, x double, y double")


def values(df, col):
    return [r[col] for r in df.orderBy("t").collect()]


def test_kalman_against_numpy(spark):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.uniform(0.5, 1.5, 30))
    z = np.sin(t / 4) * 5 + rng.normal(0, 0.5, 30)
    q, r = 0.3, 0.5
    xs, ps, xp, pp = [np.array([z[0], 0.0])], [np.array([[r, 0], [0, 1.0]])], [None], [None]
    for k in range(1, 30):
        dt = t[k] - t[k - 1]
        f = np.array([[1, dt], [0, 1]])
        a, p = f @ xs[-1], f @ ps[-1] @ f.T + q * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
        g = p[:, 0] / (p[0, 0] + r)
        xp.append(a), pp.append(p)
        xs.append(a + g * (z[k] - a[0])), ps.append(p - np.outer(g, p[0]))
    s = [xs[-1]]
    for k in range(28, -1, -1):
        f = np.array([[1, t[k + 1] - t[k]], [0, 1]])
        s.append(xs[k] + ps[k] @ f.T @ np.linalg.inv(pp[k + 1]) @ (s[-1] - xp[k + 1]))
    out = tracks.kalman(frames(spark, [(a, b, 0) for a, b in zip(t, z)]), ["track"], "t", "x", q, r)
    assert np.allclose(values(out, "smooth"), [v[0] for v in s[::-1]], atol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 12])
def test_savgol_keeps_a_parabola(spark, n):
    df = frames(spark, [(k, 2 + 3 * k - 0.5 * k * k, 0) for k in range(n)])
    out = tracks.savgol(df, ["track"], ["t"], "x", 7, 2)
    assert np.allclose(values(out, "smooth"), [2 + 3 * k - 0.5 * k * k for k in range(n)], atol=1e-6)


def test_gradient_is_numpys(spark):
    t = np.array([0, 1, 1.5, 4, 4.2, 7])
    x = t**3
    w = tracks.track(["track"], ["t"])
    out = frames(spark, [(a, b, 0) for a, b in zip(t, x)]).withColumn("g", tracks.gradient(F.col("x"), F.col("t"), w))
    assert np.allclose(values(out, "g"), np.gradient(x, t), atol=1e-9)


def test_gap_filling_and_despiking(spark):
    df = frames(spark, [(0, 0, 0), (3, 3, 0), (20, 20, 0)])
    out = tracks.fill_gaps(df, ["track"], "t", ["x"], 1.0, 5.0)
    assert values(out, "x") == [0, 1, 2, 3, 20]
    kept = tracks.despike(frames(spark, [(0, 0, 0), (1, 50, 0), (2, 2, 0), (3, 3, 0)]), ["track"], "t", "x", "y", 2.0)
    assert values(kept, "x") == [0, 2, 3]


def planted(spark, corner=90):
    """Straight along +y at speed 1, a corner that slows to 0.3, straight on."""
    pts, x, y, h = [], 0.0, 0.0, 0.0
    for k in range(40):
        v = 0.3 if 19 <= k <= 20 else 1.0
        if 18 <= k < 21:
            h += corner / 3
        pts.append((k, x, y, v, h))
        x, y = x + v * math.sin(math.radians(h)), y + v * math.cos(math.radians(h))
    df = spark.createDataFrame([(1, float(t), float(v), float(h)) for t, x, y, v, h in pts], "track long, h double, speed double, turned double")
    return turns.indexed(df, ["track"], ["h"])


def test_planted_corner_is_found_once(spark):
    f = planted(spark)
    found = turns.detect(f, ["track"], least_speed=0.5)
    rows = found.collect()
    assert len(rows) == 1 and 18 <= rows[0]["apex"] <= 21
    m = turns.metrics(f, found, ["track"]).first()
    assert abs(m["angle"] - 90) < 1e-6 and m["valid"] and m["slowest"] == 0.3
    assert turns.detect(planted(spark, 0), ["track"], least_speed=0.5).count() == 0


def test_circle_fit(spark):
    pts = [(k, 3 + 5 * math.cos(k), -2 + 5 * math.sin(k)) for k in range(8)]
    c = turns.circle(frames(spark, pts), ["track"], "x", "y").first()
    assert np.allclose([c["cx"], c["cy"], c["radius"]], [3, -2, 5])
    assert turns.circle(frames(spark, [(k, k, k) for k in range(5)]), ["track"], "x", "y").first()["radius"] is None


def test_guarded_join_refuses_to_fan_out(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    with pytest.raises(ValueError):
        joins.left_guarded(a, spark.createDataFrame([(1, 1), (1, 2)], "k long, v long"), ["k"])


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=200), rng.integers(0, 20, 200)
    y = 1 + 2 * x + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), int(k)) for a, b, k in zip(x, y, g)], "x double, y double, g long")
    d = np.column_stack([np.ones(200), x])
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    e = y - d @ beta
    meat = sum(np.outer(d[g == k].T @ e[g == k], d[g == k].T @ e[g == k]) for k in np.unique(g))
    bread, n = np.linalg.inv(d.T @ d), len(np.unique(g))
    se = np.sqrt(np.diag(n / (n - 1) * 199 / 198 * bread @ meat @ bread))
    fit = stats.ols(df, ["x"], "y", "g")
    assert np.allclose(fit["beta"], beta) and np.allclose(fit["se"], se)


def test_fuzzy_one_to_one_against_brute_force(spark):
    import random

    import swerve.plans.registry  # noqa: F401  (the plans import one another through it)
    from swerve.plans.linking import fuzzy_one_to_one

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return 1 - row[-1] / max(len(a), len(b), 1)

    r = random.Random(3)
    part = [(k, "same", "Brand#1", 99) for k in range(1000, 1260)]  # 130 tied on each side
    part += [(k, r.choice(["old ring", "hot ring", "hot gear", "", "x", "".join(r.choice("abc") for _ in range(r.randint(1, 9)))]), f"Brand#{r.randint(1, 12)}", r.choice([3, 40])) for k in range(160)]
    part += [(k, None, "Brand#1", 3) for k in (500, 501)]
    pairs = []
    for a in part:
        for b in part:
            if a[0] % 2 == 0 and b[0] % 2 == 1 and a[3] == b[3] and a[1] is not None and b[1] is not None:
                s = round(0.7 * edit(a[1], b[1]) + 0.3 * edit(a[2], b[2]), 6)
                if s >= 0.6:
                    pairs.append((-s, a[0], b[0]))
    want, ls, rs = [], set(), set()
    for s, a, b in sorted(pairs):
        if a not in ls and b not in rs:
            want.append((a, b, -s))
            ls.add(a)
            rs.add(b)
    got = fuzzy_one_to_one(spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_size int")).collect()
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_concordance_of_all_pairs(spark):
    r = np.random.default_rng(8)
    data = [(int(r.integers(0, 40)) / 4, float(r.integers(0, 7)), bool(r.integers(0, 2))) for _ in range(300)]
    pairs = [(a[1], b[1]) for a in data for b in data if a[2] and a[0] < b[0]]
    out = stats.concordance(spark.createDataFrame(data, "time double, risk double, event boolean"), "time", "risk", "event").first()
    assert tuple(out) == (len(pairs), sum(x > y for x, y in pairs), sum(x == y for x, y in pairs))


def test_suppression_against_brute_force(spark):
    """Runs settled by themselves give what one greedy pass over the whole track gives."""
    r = np.random.default_rng(5)
    cand = [(k % 3, int(i), float(r.integers(1, 9))) for k in range(3) for i in sorted(r.choice(200, 60, replace=False))]
    got = {(x["track"], x["i"]) for x in turns.accepted(spark.createDataFrame(cand, "track long, i long, score double"), ["track"], 5).collect()}
    want = set()
    for t, i, s in sorted(cand, key=lambda x: (x[0], -x[2], x[1])):
        if all(u != t or abs(i - j) >= 5 for u, j in want):
            want.add((t, i))
    assert got == want
    segs = [(1, h, float(r.integers(1, 9)), h + 1, h - int(r.integers(0, 6)), h + 1 + int(r.integers(0, 6))) for h in range(0, 300, 4)]
    got = {x["hit"] for x in turns.without_overlap(spark.createDataFrame(segs, "track long, hit long, score double, apex long, first long, last long"), ["track"]).collect()}
    kept = []
    for s in sorted(segs, key=lambda x: (-x[2], x[1])):
        if not any(min(k[5], s[5]) - max(k[4], s[4]) + 1 > 0.5 * (s[5] - s[4] + 1) for k in kept):
            kept.append(s)
    assert got == {s[1] for s in kept}


def test_segments_against_brute_force(spark):
    r = np.random.default_rng(6)
    v = [float(r.integers(0, 6)) for _ in range(120)]
    f = spark.createDataFrame([(1, k, s) for k, s in enumerate(v)], "track long, i long, speed double")
    hits = list(range(0, 120, 3))
    got = {(x["hit"], x["apex"], x["first"], x["last"]) for x in turns.segments(f, spark.createDataFrame([(1, h, 1.0) for h in hits], "track long, i long, score double"), ["track"], 4, 6).collect()}
    want = set()
    for h in hits:
        apex = min(range(h, min(h + 4, 119) + 1), key=lambda k: (v[k], k))
        last = next((k - 1 for k in range(apex + 1, min(apex + 6, 119) + 1) if v[k] < v[k - 1]), min(119, apex + 6))
        first = next((k + 1 for k in range(apex - 1, max(apex - 6, 0) - 1, -1) if v[k] < v[k + 1]), max(0, apex - 6))
        want.add((h, apex, first, last))
    assert got == want


def test_radius_and_lateral_acceleration(spark):
    """On a circle of radius 10 at speed 2 a turn has that radius, no residual and v^2 / r."""
    pts = [(1, k, 10 * math.sin(k / 5), 10 * math.cos(k / 5), 2.0, float(k), k * 180 / math.pi / 5) for k in range(30)]
    f = spark.createDataFrame(pts, "track long, i long, x double, y double, speed double, h double, turned double")
    m = turns.metrics(f, spark.createDataFrame([(1, 3, 1.0, 8, 5, 14)], "track long, hit long, score double, apex long, first long, last long"), ["track"]).first()
    assert np.allclose([m["radius"], m["residual"], m["lateral"], m["angle"]], [10, 0, 0.4, 9 * 180 / math.pi / 5])


def test_random_intercept_quantiles_against_numpy(spark):
    r = np.random.default_rng(12)
    g = r.integers(0, 25, 1500)
    x = r.uniform(0, 10, 1500)
    y = 3 + 2 * x + r.normal(0, 4, 25)[g] + r.normal(0, 1 + x / 4)
    tau, tau2, eps = 0.9, 9.0, 1e-3
    d = np.column_stack([np.ones(1500), x])
    beta, u = np.linalg.lstsq(d, y, rcond=None)[0], np.zeros(25)
    z = np.eye(25)[g]
    for _ in range(40):  # the same penalised weighted least squares, solved whole
        res = y - d @ beta - u[g]
        w = np.where(res > 0, tau, 1 - tau) / np.maximum(np.abs(res), eps)
        a = np.hstack([d, z])
        both = np.linalg.solve(a.T @ (w[:, None] * a) + np.diag([0, 0] + [1 / tau2] * 25), a.T @ (w * y))
        done = np.abs(both[:2] - beta).max() < 1e-6 * (1 + np.abs(beta).max())
        beta, u = both[:2], both[2:]
        if done:
            break
    df = spark.createDataFrame([(int(k), float(a), float(b)) for k, a, b in zip(g, x, y)], "g long, x double, y double")
    got, intercepts = stats.quantile_regression(df, ["x"], "y", "g", tau, tau2)
    assert np.allclose(got, beta, atol=1e-5) and np.allclose([v["u"] for v in intercepts.orderBy("g").collect()], u, atol=1e-4)
    assert abs((y <= d @ got + u[g]).mean() - tau) < 0.03


def test_quantile_fits_reach_their_share(spark):
    r = np.random.default_rng(13)
    data = [(float(x), float(2 * x + r.exponential(3)), int(k % 3)) for k, x in enumerate(r.uniform(0, 10, 900))]
    df = spark.createDataFrame(data, "x double, y double, fold int")
    fits = stats.quantile_fits(df, {f"{n}{k}": (xs, F.col("fold") != k) for k in range(3) for n, xs in (("c", []), ("x", ["x"]))}, "y", 0.8)
    for k in range(3):
        own = [(x, y) for x, y, f in data if f != k]
        assert abs(np.mean([y <= fits[f"c{k}"][0] for x, y in own]) - 0.8) < 0.02
        assert abs(np.mean([y <= fits[f"x{k}"][0] + fits[f"x{k}"][1] * x for x, y in own]) - 0.8) < 0.02


def test_poisson_weights_and_ranks(spark):
    w = replicates.replicate_sums(spark.range(400).select(F.col("id").alias("g"), F.lit(1).alias("n")), "g", ["n"], 50, 3).collect()
    assert len(w) == 50 and abs(np.mean([x["n"] for x in w]) - 400) < 10 and np.std([x["n"] for x in w]) < 40
    v = [float(x) for x in np.random.default_rng(2).integers(0, 40, 300)]
    got = {(x["v"], x["r"]) for x in stats.average_ranks(spark.createDataFrame([(x,) for x in v], "v double"), "v", "r").collect()}
    assert got == {(x, sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2) for x in v}
    q = stats.quantiles(spark.createDataFrame([(1, x) for x in v], "g long, v double"), ["g"], "v", [0.0, 0.3, 1.0]).first()
    assert np.allclose([q["q0"], q["q1"], q["q2"]], np.quantile(v, [0, 0.3, 1.0]))


def test_wls_against_numpy(spark):
    r = np.random.default_rng(7)
    x, w = r.normal(size=150), r.uniform(0.5, 2, 150)
    y = 1 - x + r.normal(size=150) / w
    fit = stats.ols(spark.createDataFrame([(float(a), float(b), float(k)) for a, b, k in zip(x, y, w)], "x double, y double, w double"), ["x"], "y", weight="w")
    d = np.column_stack([np.ones(150), x])
    bread = np.linalg.inv(d.T @ (w[:, None] * d))
    beta = bread @ d.T @ (w * y)
    s = d * (w * (y - d @ beta))[:, None]
    assert np.allclose(fit["beta"], beta) and np.allclose(fit["se"], np.sqrt(np.diag(150 / 148 * bread @ s.T @ s @ bread))) and np.allclose(fit["mde"], 2.801585 * fit["se"])
