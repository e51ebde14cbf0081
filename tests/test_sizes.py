"""Jobs whose disk, memory or time once grew faster than their input, on small tables against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swerve.operators import stats
from swerve.plans import registry  # isort: skip  (first: it imports the plans)
from swerve.plans import joining


def test_one_sided_keys(spark, monkeypatch):
    """Null keys, keys of both sides, rows of neither; a task gets no more groups where there are more rows."""
    monkeypatch.setattr(joining, "TASK_ROWS", 3)
    rows = [(1, 1, "F"), (1, 1, "F"), (1, 2, "O"), (2, None, "F"), (2, None, "O"), (None, 3, "O"), (4, 4, None), (5, 5, "X"), (6, 6, "F"), (6, 6, "O")]
    out = joining.one_sided(spark.createDataFrame(rows, "a int, b int, s string"), ["a", "b"], F.col("s") == "F", F.col("s") == "O")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1), (1, 2), (None, 3)], key=str)
    assert out.rdd.getNumPartitions() == 8 // 3 + 1


@pytest.mark.parametrize("longest", [1 << 17, 40, 0])
def test_block_permutations(spark, monkeypatch, longest):
    """Against plain Python over Spark's hashes, for blocks within batches, over several batches and beyond the limit;
    no plan repeats the rows of blocks within it."""
    monkeypatch.setattr(stats, "BLOCK_ROWS", longest)
    r, reps = np.random.default_rng(4), 5
    some = lambda v: None if r.random() < 0.1 else v
    rows = [(some(int(min(r.integers(0, 9), 6))), some(k), k % 7, some(float(r.normal())), some(float(r.normal(50, 3)))) for k in range(300)]
    df = spark.createDataFrame(rows, "b long, k long, j int, x double, y double").dropDuplicates(["b", "k", "j"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        out = stats.block_permutations(df, "b", ["k", "j"], "x", "y", reps, 3)
        got = {g.rep: g.r for g in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf = df.where("b is not null").select("*", *[F.xxhash64(F.lit(3), F.lit(q), "k", "j").alias(f"h{q}") for q in range(1, reps + 1)]).collect()
    low = lambda t: tuple((v is not None, v or 0) for v in t)
    for rep in range(reps + 1):
        pairs = []
        for b in {p.b for p in pdf}:
            own = sorted((p for p in pdf if p.b == b), key=lambda p: low((p.k, p.j)))
            dealt = sorted(own, key=lambda p: p[f"h{rep}"]) if rep else own
            pairs += [(p.x, q.y) for p, q in zip(own, dealt, strict=True) if p.x is not None and q.y is not None]
        assert np.isclose(got[rep], np.corrcoef(*zip(*pairs, strict=True))[0, 1])
    assert ("Generate" in out._jdf.queryExecution().toString()) == (longest < 100)


@pytest.mark.parametrize("ranges, levels", [(1, 5), (9, 5), (9, 10000), (40, 60)])
def test_concordance_by_ranges(spark, ranges, levels):
    """Within and across ranges of times and risks, with frequent values and missing ones; rows aren't repeated."""
    r = np.random.default_rng(ranges + levels)
    time = np.where(r.random(500) < 0.3, 2.5, r.integers(0, 400, 500) / 8)
    data = [(None if r.random() < 0.03 else float(t), None if r.random() < 0.03 else float(r.integers(0, levels)), [True, False, None][r.integers(0, 3)]) for t in time]
    whole = [d for d in data if d[0] is not None and d[1] is not None]
    pairs = [(a[1], b[1]) for a in whole for b in whole if a[2] and a[0] < b[0]]
    out = stats.concordance(spark.createDataFrame(data, "time double, risk double, event boolean"), "time", "risk", "event", ranges)
    assert tuple(out.first()) == (len(pairs), sum(x > y for x, y in pairs), sum(x == y for x, y in pairs))
    assert "Generate" not in out._jdf.queryExecution().toString()
    assert tuple(stats.concordance(spark.createDataFrame([], "time double, risk double, event boolean"), "time", "risk", "event").first()) == (0, 0, 0)
