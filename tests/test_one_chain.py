"""Queries over all smoothers read the frames once and shuffle them by track only; their steps against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from swerve.plans import registry  # isort: skip  (first: it imports the plans)
from swerve.operators import stats
from swerve.operators import tracks as T
from swerve.operators import turns as U
from swerve.plans import turning

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, scans, shuffles", [("ts_smoother_diagnostics", 1, 4), ("turn_attempt_table", 1, 3)])
def test_scans_and_shuffles(spark, name, scans, shuffles):
    df = registry.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan", plan)) == scans and "ExistingRDD" not in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= shuffles
    assert "us" not in " ".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan))  # frames are never dealt by time or number


def test_with_kalman(spark):
    r = random.Random(4)
    rows = [(k, t, t * 1.5 + r.random(), r.gauss(0, 9), r.gauss(5, 2)) for k in range(4) for t in r.sample(range(40), 1 + 9 * k)]
    df = spark.createDataFrame(rows, "k int, t long, h double, x double, y double")
    got = {(v.k, v.h): v for v in T.with_kalman(df, ["k"], "h", {"x": "sx", "y": "sy"}, 0.5, 4.0).collect()}
    assert sorted((v.k, v.t, v.h, v.x, v.y) for v in got.values()) == sorted(rows)
    for col, out in (("x", "sx"), ("y", "sy")):
        alone = T.kalman(df, ["k"], "h", col, 0.5, 4.0).collect()
        assert len(alone) == len(rows) and all(got[v.k, v.h][out] == v.smooth for v in alone)


def test_located_segments(spark):
    """The turns that detection carries with its hits are those of a walk in plain Python; frames without a key have none."""
    r = random.Random(6)
    rows = [(k, i, float(r.randrange(9)), r.uniform(-400, 400)) for k in (1, 2, None) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, i long, speed double, turned double")
    hits = U.located(df, ["k"]).collect()
    assert {h.k for h in hits} == {1, 2}
    for h in hits:
        speed = {i: s for k, i, s, _ in rows if k == h.k}
        apex = min((i for i in speed if h.hit <= i <= h.hit + 4), key=lambda i: (speed[i], i))
        first = last = apex
        while last + 1 in speed and last < apex + 6 and not speed[last + 1] < speed[last]:
            last += 1
        while first - 1 in speed and first > apex - 6 and not speed[first - 1] < speed[first]:
            first -= 1
        assert tuple(h.walk) == (apex, first, last) and tuple(h.window) == (apex, h.hit, min(h.hit + 4, 49))


def test_shuffled(spark):
    rows = [(k, i, float(i * i % 17), i + 0.5) for k in (1, 2, None) for i in range(30)]
    df = spark.createDataFrame(rows, "track int, i long, dh double, speed double")
    got = turning.shuffled(df).collect()
    assert sorted((v.track, v.i, v.dh, v.speed) for v in got) == [v for v in rows if v[0]]
    for k in (1, 2):
        order = df.where(f"track = {k}").orderBy(F.md5(F.concat_ws(":", F.lit("7"), "track", "i"))).collect()
        total = 0.0
        for v, other in zip(sorted((v for v in got if v.track == k), key=lambda v: v.i), order, strict=True):
            total += other.dh
            assert (v.new_dh, v.turned) == (other.dh, total)


def test_quantile_regression_shuffles_rows_once(spark, monkeypatch):
    """Keys of one row, of several arrays and of several batches: the same fit whatever the packing; rounds shuffle sums only."""
    r = random.Random(8)
    rows = [(k, float(x), 3 * x + k + r.expovariate(0.5)) for k, n in ((1, 1), (2, 130), (3, 45), (4, 7)) for x in (r.uniform(0, 9) for _ in range(n))]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (2, None, 1.0), (2, 1.0, None)], "g long, x double, y double")
    plans, real, fits = [], stats.stored, []
    monkeypatch.setattr(stats, "stored", lambda t: plans.append(t._jdf.queryExecution().executedPlan().toString()) or real(t))
    for rows_of_array, batch in ((1024, "10000"), (10, "64")):
        monkeypatch.setattr(stats, "PACKED_ROWS", rows_of_array)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            beta, u = stats.quantile_regression(df, ["x"], "y", "g", 0.7, 2.0)
            fits.append([*beta, *[v.u for v in u.orderBy("g").collect()]])
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(fits[0]) == 2 + 4 and fits[0] == pytest.approx(fits[1], abs=1e-4)
    later = plans[1].split("InMemoryTableScan")
    assert len(later) == 2 and "Exchange" not in later[0].split("MapInArrow")[1] and "SortMergeJoin" not in plans[1]
