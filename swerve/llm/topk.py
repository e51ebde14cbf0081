"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query in blocks. Each query keeps an interval of scores
that is known to hold its kth best score. A round counts the scores of the interval in bins,
adds the counts up over all blocks and narrows the interval to the bin with the kth score. When
an interval is one score wide, the scores above it and the smallest ids at it are the answer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, batch_of

#: Queries sent to the executors at once, vectors scored at once, and bins of a histogram.
QUERY_GROUP, BLOCK, BINS = 4096, 256, 128


def _blocks(batches, dim: int):
    for batch in batches:
        n = batch.num_rows
        for k in range(0, n, BLOCK):
            part = batch.slice(k, BLOCK)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            yield ids, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)


def _scores(ids, v, query_ids, queries):
    """Integer scores, queries by vectors; a query's own row scores below everything."""
    s = (queries @ v.T).astype(np.int64) if queries.dtype != object else queries.dot(v.T.astype(object))
    own = query_ids[:, None] == ids[None, :]
    return s, own


def _histograms(shared, dim: int, k: int):
    """(query, bin, n) for the bins that can matter: from the top down to the block's own kth score."""
    schema = {"q": pa.int32(), "bin": pa.int32(), "n": pa.int64()}

    def run(batches):
        query_ids, queries, lo, width = shared.value
        total = np.zeros((len(query_ids), BINS + 1), np.int64)
        for ids, v in _blocks(batches, dim):
            s, own = _scores(ids, v, query_ids, queries)
            b = np.clip((s - lo[:, None]) // width[:, None], -1, BINS - 1)
            b[own] = -1
            flat = b + 1 + (np.arange(len(query_ids)) * (BINS + 1))[:, None]
            total += np.bincount(flat.ravel(), minlength=total.size).reshape(total.shape)
        counts = total[:, 1:]
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield batch_of(schema, q=q, bin=b, n=counts[q, b])

    return run


def _range(shared, dim: int):
    schema = {"lo": pa.int64(), "hi": pa.int64()}

    def run(batches):
        query_ids, queries = shared.value
        for ids, v in _blocks(batches, dim):
            s, own = _scores(ids, v, query_ids, queries)
            yield batch_of(schema, lo=[int(s.min())], hi=[int(s.max())])

    return run


def _answers(shared, dim: int, k: int):
    schema = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}

    def run(batches):
        query_ids, queries, kth = shared.value
        for ids, v in _blocks(batches, dim):
            s, own = _scores(ids, v, query_ids, queries)
            keep = (s > kth[:, None]) & ~own
            q, c = np.nonzero(keep)
            tie_q, tie_c = np.nonzero((s == kth[:, None]) & ~own)
            order = np.lexsort((ids[tie_c], tie_q))
            tie_q, tie_c = tie_q[order], tie_c[order]
            first = np.searchsorted(tie_q, tie_q)
            few = np.arange(len(tie_q)) - first < k
            q, c = np.concatenate([q, tie_q[few]]), np.concatenate([c, tie_c[few]])
            yield batch_of(schema, query_id=query_ids[q], vec_id=ids[c], score=s[q, c])

    return run


def topk_by_histogram(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, group: int = QUERY_GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best rows of vectors, its own id left out.

    A component x counts as floor(scale * x); the score is the integer inner product; ties go to
    the smaller vec_id. Rows with a null id or vector, a null or non-finite component, or another
    length than the queries' commonest take no part. A query with fewer than k candidates gets
    all. Repeated rows are separate candidates; a repeated query id is asked once, with its smallest vector. An empty table gives an empty result. Queries go
    out in groups of a fixed size, so no broadcast grows with the data.
    """
    spark, store = vectors.sparkSession, Store(vectors.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
        df = df.where(F.col(id_col).isNotNull() & v.isNotNull() & ok)
        return df.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))

    asked = clean(queries)
    dims = asked.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out_schema = "query_id long, rank int, vec_id long, score long"
    if not dims or dims[0]["d"] == 0:
        return spark.createDataFrame([], out_schema)
    dim = dims[0]["d"]
    asked, all_rows = asked.where(F.size("v") == dim), clean(vectors).where(F.size("v") == dim)
    rows = store.put(all_rows, "vectors")
    largest = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0.0
    exact_in_double = dim * largest * largest < 2**53
    groups = max(1, math.ceil(asked.count() / group))
    parts = []
    for g in range(groups):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).groupBy("id").agg(F.min("v").alias("v")).toPandas()
        if not len(mine):
            continue
        ids, q = mine["id"].to_numpy(np.int64), np.stack(mine["v"].to_numpy()).astype(np.float64)
        q = q if exact_in_double else q.astype(np.int64).astype(object)
        send = spark.sparkContext.broadcast
        bounds = rows.mapInArrow(_range(send((ids, q)), dim), "lo long, hi long").agg(F.min("lo"), F.max("hi")).first()
        lo, hi = np.full(len(ids), bounds[0] if bounds[0] is not None else 0, np.int64), np.full(len(ids), bounds[1] if bounds[1] is not None else 0, np.int64)
        left, first = np.full(len(ids), k, np.int64), True
        while first or (hi > lo).any():
            first = False
            width = np.maximum(1, -(-(hi - lo + 1) // BINS))
            found = rows.mapInArrow(_histograms(send((ids, q, lo, width)), dim, k), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toPandas()
            counts = np.zeros((len(ids), BINS), np.int64)
            counts[found["q"], found["bin"]] = found["n"]
            # what lies above the interval stands in its last bin, as scores are clipped there
            below_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
            reach = below_top >= k
            at = np.where(reach.any(axis=1), BINS - 1 - np.argmax(reach[:, ::-1], axis=1), 0)
            last = (at + 1) * width - 1 + lo
            lo, hi = lo + at * width, np.minimum(hi, last)
        parts.append(rows.mapInArrow(_answers(send((ids, q, lo)), dim, k), "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], out_schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
