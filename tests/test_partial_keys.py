"""Segmentations, threshold comparison and smoother diagnostics against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swerve.operators import tracks as T
from swerve.operators import turns as U
from swerve.plans import registry, tracking, turning

SF = "/root/testdata/sf0.001"


def brute_match(a, b, reach):
    out, la, lb = [], set(), set()
    for _, x, y in sorted((abs(x - y), x, y) for x in a for y in b if abs(x - y) <= reach):
        if x not in la and y not in lb:
            out.append((x, y))
            la.add(x), lb.add(y)
    return out


@pytest.mark.parametrize("reach", [0, 3, 9])
def test_matched(spark, reach):
    r = random.Random(reach)
    sides = [{k: sorted(r.sample(range(120), r.randrange(40))) for k in range(6)} for _ in range(2)]
    a, b = (spark.createDataFrame([(k, i) for k, v in s.items() for i in v], "k int, apex long") for s in sides)
    got = sorted(tuple(x) for x in U.matched(a, b, ["k"], reach).collect())
    assert got == sorted((k, *p) for k in range(6) for p in brute_match(sides[0][k], sides[1][k], reach))


def test_window_segments(spark):
    speed = [9, 8, 3, 5, 4, 2, 7, 1]
    frames = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(speed)], "k int, i long, speed double")
    hits = spark.createDataFrame([(1, 0, 70.0), (1, 2, 80.0), (1, 6, 90.0)], "k int, i long, score double")
    got = sorted((r.hit, r.apex, r["first"], r["last"]) for r in U.window_segments(frames, hits, ["k"], 4).collect())
    assert got == [(0, 2, 0, 4), (2, 5, 2, 6), (6, 7, 6, 7)]
    with pytest.raises(ValueError):
        U.detect(frames, ["k"], segmentation="other")


def test_attempt_table(spark):
    got = {r.track: r for r in registry.QUERIES["turn_attempt_table"](spark, SF).collect()}
    r = turning.running(spark, SF)
    rows = r.orderBy("track", "i").toPandas()
    assert {k: v.n_frames for k, v in got.items()} == rows.groupby("track").size().to_dict()
    assert {k: v.speed_above_cap for k, v in got.items()} == rows.groupby("track").speed.apply(lambda s: int((s > turning.SPEED_CAP).sum())).to_dict()
    for name, key in (("walk", "seg_walk"), ("window", "seg_window"), ("walk", "turns_raw")):
        n = Counter(x.track for x in U.detect(r, ["track"], segmentation=name).collect())
        assert {k: v[key] for k, v in got.items()} == {k: n[k] for k in got}


def test_threshold_delta(spark):
    r = random.Random(1)
    rows = [(k, i, r.choice("xy"), r.uniform(-170, 170), strict, dealt) for dealt in (False, True) for strict in (False, True) for k in range(4) for i in sorted(r.sample(range(60), 12))]
    found = spark.createDataFrame(rows, "track long, apex long, label string, angle double, strict boolean, dealt boolean")
    of = lambda strict: found.where(~F.col("dealt") & (F.col("strict") == strict))
    got = {(x.scope, x.key): x for x in turning.threshold_delta(found, U.matched(of(False), of(True), ["track"], 3)).collect()}
    pick = lambda k, strict: [x[1] for x in rows if x[0] == k and x[4] == strict and not x[5]]
    pairs = {k: brute_match(pick(k, False), pick(k, True), 3) for k in range(4)}
    for (scope, key), x in got.items():
        some = [v for v in rows if scope == "all" or (scope == "label" and v[2] == key) or (scope == "track" and str(v[0]) == key)]
        n = Counter((v[4], v[5]) for v in some)
        assert (x.turns_loose, x.turns_strict, x.null_loose, x.null_strict) == (n[False, False], n[True, False], n[False, True], n[True, True])
        new = [v for v in some if v[4] and not v[5] and v[1] not in {b for _, b in pairs[v[0]]}]
        lost = [v for v in some if not v[4] and not v[5] and v[1] not in {a for a, _ in pairs[v[0]]}]
        assert (x.new, x.lost, x.matched) == (len(new), len(lost), x.turns_strict - len(new))
        assert x.excess == x.turns_strict - x.turns_loose - x.null_strict + x.null_loose
        assert x.from_30_loose == sum(30 <= abs(v[3]) < 60 for v in some if not v[4] and not v[5])
    assert sum(k[0] == "track" for k in got) == 4 and got["all", "all"].matched + got["all", "all"].lost == got["all", "all"].turns_loose


def test_smoother_diagnostics(spark):
    r = np.random.default_rng(4)
    long = [(name, k, t, t / 10.0, float(abs(r.normal(10, 4))), float(r.uniform(0, 360))) for name in ("a", "b", "c") for k in range(5) for t in range(30 if k else 6)]
    got = {x.smoother: x for x in T.smoother_diagnostics(spark.createDataFrame(long, "smoother string, track int, us long, h double, speed double, heading double"), 60.0, 0.3, 5.0, 0.4, 0.0).collect()}
    speeds = {(n, k): np.array([x[4] for x in long if x[:2] == (n, k)]) for n in "abc" for k in range(1, 5)}
    rms = {}
    for n in "abc":
        exceed, rising, peak, until, sd, off = [], [], [], [], [], []
        for k in range(1, 5):
            sp, hd = speeds[n, k], np.radians([x[5] for x in long if x[:2] == (n, k)])
            exceed.append(np.mean(np.abs(np.gradient(sp, 0.1)) > 60))
            rising.append(np.mean(np.diff(sp[:9]) > 0))
            peak.append(sp.max())
            until.append(sp.argmax() / 10)
            m = sp > 5
            sd.append(math.degrees(math.sqrt(-2 * math.log(math.hypot(np.sin(hd[m]).mean(), np.cos(hd[m]).mean())))))
            off.append(np.sqrt(np.mean((sp - np.median([speeds[v, k] for v in "abc"], axis=0)) ** 2)))
        x, rms[n] = got[n], np.median(off)
        assert x.tracks == 4
        assert np.allclose([x.exceed_share, x.rising_share, x.peak_speed, x.time_to_peak, x.heading_sd, x.rms_to_ensemble], [np.mean(exceed), np.mean(rising), np.median(peak), np.median(until), np.median(sd), np.median(off)])
    fit = [n for n in "abc" if got[n].eligible]
    assert [n for n in "abc" if got[n].recommended] == [min(fit, key=rms.get) if fit else min("abc", key=lambda n: got[n].exceed_share)]
    assert set(tracking.SMOOTHERS) == {x.smoother for x in registry.QUERIES["ts_smoother_diagnostics"](spark, SF).collect()}


def test_smoother_range(spark):
    r = random.Random(3)
    rows = [(n, k, i, *(r.random() for _ in turning.MEASURES)) for n in ("raw", "a", "b") for k in range(5) for i in sorted(r.sample(range(60), 9))]
    rows = [(*v[:-2], None if v[2] % 7 == 0 else v[-2], v[-1]) for v in rows]
    found = spark.createDataFrame(rows, "smoother string, track long, apex long, " + ", ".join(f"{m} double" for m in turning.MEASURES))
    got = {(x.track, x.apex): x for x in turning.smoother_range(found).collect()}
    assert set(got) == {v[1:3] for v in rows if v[0] == "raw"}
    for n, k, i, *own in (v for v in rows if v[0] == "raw"):
        near = [min((v for v in rows if v[:2] == (o, k) and abs(v[2] - i) <= 3), key=lambda v: (abs(v[2] - i), v[2]), default=None) for o in "ab"]
        held = [v[3:] for v in near if v]
        assert got[k, i].matched == len(held)
        for j, m in enumerate(turning.MEASURES):
            values = [v[j] for v in [own, *held] if v[j] is not None]
            want = (round(min(values), 3), round(max(values), 3)) if values else (None, None)
            assert (got[k, i][f"lo_{m}"], got[k, i][f"hi_{m}"]) == want


@pytest.mark.parametrize("axis, times, want", [
    ([0, 4, 8], [0, 1, 2], (True, True, 1.25, 1.0, "none")), ([0, 8], [0, 3], (True, False, None, 3.0, "forbidden")), ([0, 1, 8], [0, 9, 12], (True, True, 9 + 3 * 4 / 7, 3.0, "bridged")),
    ([0, 1, 8], [0, 9, 16], (True, False, None, 7.0, "too_long")), ([6, 8], [0, 1], (True, True, 0.0, 0.0, "none")), ([0, 1], [0, 1], (False, False, None, None, "none")), ([0, None, 10], [0, 1, 2], (True, True, 1.0, 2.0, "none")), ([None], [0], (False, False, None, None, "none")),
])
def test_crossing(spark, axis, times, want):
    rows = spark.createDataFrame([(1, i, float(t), None if a is None else float(a)) for i, (a, t) in enumerate(zip(axis, times))], "k int, i int, t double, a double")
    x = T.crossing(rows, ["k"], ["i"], "t", "a", 5.0, 2.0, 5.0, 4.0).first()
    assert (x.crossed, x.ok, x.gap, x.policy) == (want[0], want[1], want[3], want[4]) and x.crossed_at == (None if want[2] is None else pytest.approx(want[2]))
