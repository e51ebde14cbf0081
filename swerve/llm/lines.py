"""Line deduplication: lines found in many documents go everywhere.

The distinct line hashes that reach the document count are dealt into shards. Each shard has a
minimal perfect hash that leads to a fingerprint array and a count array; documents probe these
arrays and no line is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, U64, Store, batch_of, free_name, once, sparing
from .mph import PerfectHash

MIN_DOCS = 10
SHARD_LINES = 1 << 18
#: The index is broadcast up to this many bytes; beyond it, probes are dealt out to the shards.
BROADCAST_BYTES = 64 << 20
CHUNK = 1 << 21
SEED = 17


def line_hashes(text: str) -> tuple[list[str], np.ndarray]:
    """Lines of a text and the hash of each line's key; 0 for an empty key."""
    lines = text.split("\n")
    keys = [x.strip(SPACE).lower() for x in text.encode("utf-8", "surrogatepass").split(b"\n")]  # bytes: only A-Z change
    return lines, np.fromiter((xxhash.xxh3_64_intdigest(k, SEED) | 1 if k else 0 for k in keys), U64, len(keys))


@sparing
def _count_lines(batches):
    schema, kept, total = {"h": pa.int64(), "c": pa.int64()}, [], 0

    def out():
        h, c = np.unique(np.concatenate(kept), return_counts=True)
        return batch_of(schema, h=h.view(np.int64), c=c)

    for batch in batches:
        for text in batch.column("text").to_pylist():
            h = np.unique(line_hashes(text or "")[1])
            kept.append(h[h != 0])
            total += len(h)
            if total >= CHUNK:
                yield out()
                kept, total = [], 0
    if kept:
        yield out()


def _build(key, group):
    h = np.sort(group.column("h").to_numpy().view(U64))
    by = dict(zip(group.column("h").to_numpy().view(U64).tolist(), group.column("c").to_numpy().tolist(), strict=True))
    index = PerfectHash.build(h)
    slot, prints, counts = index.slots(h), np.zeros(len(h), U64), np.zeros(len(h), np.uint32)
    prints[slot] = h
    counts[slot] = np.minimum([by[x] for x in h.tolist()], 0xFFFFFFFF)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "hash": [index.to_bytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()]})


class Shard:
    def __init__(self, row):
        self.index = PerfectHash.from_bytes(bytes(row["hash"]))
        self.prints, self.counts = np.frombuffer(bytes(row["prints"]), U64), np.frombuffer(bytes(row["counts"]), np.uint32)

    def count(self, h: np.ndarray) -> np.ndarray:
        """Documents that hold each line; 0 where it isn't indexed."""
        slot = self.index.slots(h)
        return np.where((slot >= 0) & (self.prints[np.maximum(slot, 0)] == h), self.counts[np.maximum(slot, 0)], 0)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


def _drop(columns: list[str], text_col: str, shards: int, shared, listed_in: str = ""):
    """Rows with their text cut; which lines go is probed in the shared shards or listed in a column."""

    @sparing
    def run(batches) -> Iterator[pa.RecordBatch]:
        index = once(shared, lambda rows: {k: Shard(r) for k, r in rows.items()}) if shared else {}
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            parsed = [line_hashes(x) for x in texts]
            flat = np.concatenate([h for _, h in parsed]) if parsed else np.zeros(0, U64)
            if shared:
                gone, shard = np.zeros(len(flat), bool), shard_of(flat, shards)
                for k, s in index.items():
                    at = np.flatnonzero((shard == k) & (flat != 0))
                    gone[at] = s.count(flat[at]) > 0
            else:
                listed = batch.column(listed_in).to_pylist()
                gone = np.concatenate([np.isin(h.view(np.int64), x) if x else np.zeros(len(h), bool) for (_, h), x in zip(parsed, listed, strict=True)]) if parsed else np.zeros(0, bool)
            kept, n_lines, n_dropped, at = [], [], [], 0
            for lines, h in parsed:
                g = gone[at : at + len(h)]
                at += len(h)
                n_lines.append(len(lines)), n_dropped.append(int(g.sum()))
                kept.append("\n".join([x for x, d in zip(lines, g.tolist(), strict=True) if not d]) if n_dropped[-1] else "\n".join(lines))
            out = [pa.array(kept, pa.string()) if c == text_col else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return run


def _probes(shards: int, salts: int):
    schema = {"shard": pa.int32(), "salt": pa.int32(), "text_hash": pa.int64(), "h": pa.int64()}

    def run(batches):
        for batch in batches:
            for t in batch.column("text").to_pylist():
                h = np.unique(line_hashes(t or "")[1])
                h = h[h != 0]
                th = np.uint64(xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass"))).astype(np.int64)
                yield batch_of(schema, shard=shard_of(h, shards), salt=np.full(len(h), abs(int(th)) % salts), text_hash=np.full(len(h), th), h=h.view(np.int64))

    return run


def _probe(left, right):
    schema = pa.schema([("text_hash", pa.int64()), ("h", pa.int64())])
    if not right.num_rows or not left.num_rows:
        return schema.empty_table()
    h = left.column("h").to_numpy()
    hit = Shard(right.slice(0, 1).to_pylist()[0]).count(h.view(U64)) > 0
    return pa.table({"text_hash": left.column("text_hash").to_numpy()[hit], "h": h[hit]}, schema=schema)


def _text_hash(columns: list[str], text_col: str, name: str):
    def run(batches):
        for batch in batches:
            th = [xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(np.array(th, U64).view(np.int64), pa.int64())], names=[*columns, name])

    return run


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with frequent lines cut out of the text, and n_lines (before) and n_dropped.

    A line's key has white space stripped at both ends and A-Z lower-cased. Lines whose key is
    not empty and stands in at least min_docs rows go from every row. Null or empty text is one
    empty line and stays an empty text. Rows with the same id each count as a document. Columns
    of docs named n_lines or n_dropped are replaced; all others are carried along.
    """
    docs = docs.drop("n_lines", "n_dropped")
    store, columns = Store(docs.sparkSession), docs.columns
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = text.mapInArrow(_count_lines, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    frequent = store.put(counted.where(F.col("c") >= min_docs), "frequent")
    n = frequent.count()
    shards = max(1, math.ceil(n / SHARD_LINES))
    dealt = frequent.withColumn("shard", F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(h, 32) * {shards}L, 32) as int)"))
    index = store.put(dealt.groupBy("shard").applyInArrow(_build, "shard int, hash binary, prints binary, counts binary"), "index")
    out = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out[text_col].dataType = T.StringType()
    if n * 16 <= broadcast_bytes:
        shared = docs.sparkSession.sparkContext.broadcast({r["shard"]: r.asDict() for r in index.collect()})
        return docs.mapInArrow(_drop(columns, text_col, shards, shared), out)
    salts = max(1, math.ceil(docs.count() / SHARD_LINES))
    probes = text.mapInArrow(_probes(shards, salts), "shard int, salt int, text_hash long, h long").distinct()
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = probes.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(_probe, "text_hash long, h long")
    key, gone = free_name("text_hash", columns), free_name("gone", columns)
    hits = store.put(hits.groupBy(F.col("text_hash").alias(key)).agg(F.collect_set("h").alias(gone)), "hits")
    with_hash = T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())])
    joined = docs.mapInArrow(_text_hash(columns, text_col, key), with_hash).join(hits, key, "left").select(*columns, gone)
    return joined.mapInArrow(_drop(columns, text_col, shards, None, gone), out)
