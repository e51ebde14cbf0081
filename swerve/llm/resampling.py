"""Resampling of documents towards a target distribution.

Features are hashed into buckets. The gain of a bucket is the logarithm of its smoothed share in the target
texts over that in the documents; the gains are one array, by which each document is scored where its
text is read. A Gumbel draw from a hash of the id is added to the weight, so that the highest scores
are a sample without replacement in proportion to the weights. The scores are persisted; exact counts over them
narrow the interval of the last score that is drawn, then, among the rows tied on it, that of the last id
and of the last row. The drawn rows are sorted by ranges, and a range's ranks begin after the rows of the ranges before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, batch_of, once

BUCKETS = 10000
#: Points of an interval at which one job counts: 1 is plain bisection, more need fewer passes.
POINTS = 15
#: Features that a worker remembers the bucket of.
KNOWN = 1 << 18
#: Ids that are null stand behind all others.
LAST = (1 << 63) - 1
#: Bytes that aren't part of a word become spaces, A-Z become a-z; bytes above 127 belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Buckets(dict):
    """Bucket of each feature: the CRC of its UTF-8 bytes modulo n."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        bucket = zlib.crc32(feature) % self.n
        if len(feature) <= 64:
            self[feature] = bucket
        return bucket


def features_of(text: str | None, grams: tuple[int, int]) -> tuple[int, Iterator[bytes], int]:
    """Words of a text, its runs of grams[0] to grams[1] words, and the number of those."""
    words = (text or "").encode().translate(FOLD).split()
    n = len(words)
    if grams == (1, 1):
        return n, iter(words), n
    runs = (b" ".join(words[i : i + k]) for k in range(grams[0], grams[1] + 1) for i in range(n - k + 1))
    return n, runs, sum(max(0, n - k + 1) for k in range(grams[0], grams[1] + 1))


def _tally(grams: tuple[int, int], n: int):
    schema = {"bucket": pa.int32(), "n": pa.int64()}

    def run(batches):
        known, counts = Buckets(n), np.zeros(n, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                _, runs, size = features_of(text, grams)
                counts += np.bincount(np.fromiter(map(known.__getitem__, runs), np.int64, size), minlength=n)
        found = np.flatnonzero(counts)
        yield batch_of(schema, bucket=found, n=counts[found])

    return run


def bucket_counts(texts: DataFrame, grams: tuple[int, int], n: int) -> np.ndarray:
    """Occurrences of the features of all texts by bucket; the driver gets one sum per bucket."""
    counts = np.zeros(n, np.int64)
    for row in texts.mapInArrow(_tally(grams, n), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed share in the target over that in the corpus, rounded down."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s + n)) / ((corpus + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _weigh(grams: tuple[int, int], shared):
    schema = {"row": pa.int64(), "id": pa.int64(), "n_words": pa.int64(), "n_features": pa.int64(), "weight": pa.int64()}

    def run(batches):
        gains = shared.value
        known, row = once(shared, lambda g: Buckets(len(g))), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words, runs, size = features_of(text, grams)
                total = int(gains[np.fromiter(map(known.__getitem__, runs), np.int64, size)].sum()) if size else 0
                out.append((words, size, total // size if size else 0))
            n_words, n_features, weight = zip(*out, strict=True) if out else ((), (), ())
            yield batch_of(schema, row=np.arange(row, row + len(out)), id=batch.column("id"), n_words=n_words, n_features=n_features, weight=weight)
            row += len(out)

    return run


def cut_point(rows: DataFrame, keys: list[Column], k: int, points: int = POINTS) -> list[int]:
    """Values of the k-th row in the order of keys (longs, ascending), as many of them as settle which
    rows are the first k. 1 <= k <= the rows. Only counts come to the driver."""
    tied, at = F.lit(True), []
    for key in keys:
        here = rows.where(tied)
        low, high = (int(x) for x in here.agg(F.min(key), F.max(key)).first())
        while low < high:
            step = max(1, (high - low) // (points + 1))
            cuts = list(range(low, high, step))[:points] if step == 1 else [low + step * i for i in range(1, points + 1)]
            counts = here.agg(*[F.count_if(key <= F.lit(c)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
            reached = [c for c, n in zip(cuts, counts, strict=True) if n >= k]
            missed = [c for c, n in zip(cuts, counts, strict=True) if n < k]
            low, high = (missed[-1] + 1 if missed else low), (reached[0] if reached else high)
        below, equal = here.agg(F.count_if(key < F.lit(low)), F.count_if(key == F.lit(low))).first()
        at.append(low)
        k -= below
        if equal == k:
            break
        tied = tied & (key == F.lit(low))
    return at


def within(keys: list[Column], at: list[int]) -> Column:
    """Whether a row stands no later than the values at."""
    first = keys[len(at) - 1] <= F.lit(at[-1])
    for key, v in zip(keys[len(at) - 2 :: -1] if len(at) > 1 else [], at[-2::-1], strict=False):
        first = (key < F.lit(v)) | ((key == F.lit(v)) & first)
    return first


def ranked(rows: DataFrame, keys: list[Column], store: Store, name: str = "rank") -> DataFrame:
    """rows with their ranks from 1 in the order of keys: sorted by ranges, a range after the rows of those before."""
    at = F.col(f"{name}_at")
    dealt = store.put(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(f"{name}_at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
    sizes, before, starts = dealt.groupBy(part.alias("part")).count().orderBy("part").collect(), 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, f"{name}_part long, {name}_before long")
    return dealt.join(F.broadcast(offsets), part == F.col(f"{name}_part")).withColumn(name, F.col(f"{name}_before") + place + 1).drop(f"{name}_at", f"{name}_part", f"{name}_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, grams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs; rank is null for those not drawn.

    Words are runs of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z. Drawn are percent
    in a hundred of the documents with at least least_words words, rounded down: those with the highest
    scores, ties to the smaller id, null ids last, equal ids to the row read first. A null id hashes as ''. Null and empty texts have no
    features and weight 0. Rows may repeat: one row per row. Texts may be of any length; a text is one
    value of its task. An empty target gives smoothed gains; an empty table an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    store = Store(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    corpus = bucket_counts(texts.select("text"), grams, buckets)
    wanted = bucket_counts(target.select(F.col(target_col).cast("string").alias("text")), grams, buckets)
    gains = spark.sparkContext.broadcast(gains_of(corpus, wanted))
    weighed = texts.mapInArrow(_weigh(grams, gains), "row long, id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = store.put(weighed.withColumn("score", F.col("weight") + noise), "scores")
    fit = scored.where(F.col("n_words") >= least_words)
    k = percent * fit.count() // 100
    out = ["id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    keys = [-F.col("score"), F.coalesce("id", F.lit(LAST)), F.col("row")]
    drawn = (F.col("n_words") >= least_words) & within(keys, cut_point(fit, keys, k))
    return ranked(scored.where(drawn), keys, store).select(*out, "rank").unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
