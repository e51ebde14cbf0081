"""Helpers shared by the text operators: the shared folder, null-safe columns, word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager, suppress
from functools import wraps
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SPACE = b" \t\n\x0b\x0c\r"
#: Words and bytes hashed at once: keeps the working arrays inside the CPU caches.
SLICE_BYTES = 1 << 19
#: Rows of a batch that are Python objects at once.
PART_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder. A cluster must name it; one process may do without."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="swerve-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/swerve-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, rows: int | None):
    """Jobs that are run inside get Arrow batches of at most so many rows: for rows that hold large arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if rows:
        spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


class Store:
    """Tables written to the shared folder, so that a lost executor costs a reread and no lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0

    def put(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """df, written and read again; batch_rows bounds the rows that a Python worker gets at once."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        with batches_of(self.spark, batch_rows):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Free memory goes back to the system: Spark keeps idle Python workers, which would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def sparing(run):
    """A function for mapInArrow that gets batches in parts of PART_ROWS rows and gives its memory back at a task's end."""

    @wraps(run)
    def out(batches):
        yield from run(b.slice(k, PART_ROWS) for b in batches for k in range(0, max(1, b.num_rows), PART_ROWS))
        give_back()

    return out


def once(shared, build):
    """build(shared.value) for a broadcast, made once in each Python worker and kept for its later tasks."""
    if not hasattr(shared, "made"):
        shared.made = build(shared.value)
    return shared.made


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it until no column in any spelling has it."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with null text as the empty text; other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def total_bytes(docs: DataFrame, col: str = "text") -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()[0])


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    A word is a maximal run of bytes that are not separators; A-Z count as a-z. The hash of a
    word is a difference of prefix sums of byte values times powers of an odd base, so one pass
    over the bytes serves all words.
    """

    def __init__(self, separators: Iterable[int] = SPACE):
        rng = np.random.default_rng(20240517)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
        for c in range(ord("A"), ord("Z") + 1):
            self.value[c] = self.value[c + 32]
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        self.base, self.size = 0x5851F42D4C957F2D, 0
        self.grow(SLICE_BYTES)

    def grow(self, n: int) -> None:
        if n <= self.size:
            return
        inv = pow(self.base, -1, 1 << 64)
        self.power, self.inverse = (np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(b))])) for b in (self.base, inv))
        self.size = n

    def words(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first and last byte (exclusive) of each word, and for each text (they begin at
        `begins`, the last is the end of data) the number of words before it."""
        self.grow(len(data) + 1)
        if not len(data):
            e = np.zeros(0, np.int64)
            return np.zeros(0, U64), e, e, np.zeros(len(begins), np.int64)
        letter = ~self.sep[data]
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        cut = begins[(begins > 0) & (begins < len(data))]
        first[cut] = letter[cut]
        last = letter.copy()
        last[:-1] &= ~letter[1:]
        last[cut - 1] = letter[cut - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.inverse[start]), start, end, np.searchsorted(start, begins)


_MULT = mix(np.arange(1, 17, dtype=U64)) | U64(1)


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    if len(words) < size:
        return np.zeros(0, U64)
    total = words[: len(words) - size + 1] * _MULT[0]
    for k in range(1, size):
        total = total + words[k : len(words) - size + 1 + k] * _MULT[k]
    return mix(total, 7)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a column of texts; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(ids: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, begins) of runs of whole texts of about SLICE_BYTES, at least one text each."""
    data, offsets = text_arrays(column)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def batch_of(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))


def crc_mod(col: str, m: int):
    """crc32 of the id as text, modulo m."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(m))
