"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a SimHash over its five-word shingles. Documents are read in windows of
an item's size (the whole document where it is shorter), of which only those with enough
shingles of items of that size are fingerprinted: a window with w shingles reaches similarity s with
an item of n shingles only if s / (1 + s) * (n + w) of its shingles are in the item. A fingerprint is
looked up in a multi-index: 64 bits in eight blocks, of which one differs in at most RADIUS // 8 bits
if the whole differs in at most RADIUS. Candidates are verified by the exact weighted Jaccard
similarity of the shingle counts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, WordHasher, free_name, keyed_text, mix, once, shingles_of, slices, sparing, text_arrays

SIZE, SIMILARITY, RADIUS, BLOCK_BITS = 5, 0.75, 23, 8
#: Items that are looked up at once; larger benchmarks go in several rounds.
ITEMS = 20_000
#: Windows, and shingles of one window, whose bits are held at once.
PIECE = 4096


def item_shingles(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Shingle hashes in order; 1 to size - 1 words are one shingle."""
    return shingles_of(words, size) if len(words) >= size else (mix(shingles_of(words, len(words)), len(words)) if len(words) else np.zeros(0, U64))


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each shingle, lowest bit first."""
    return np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def ones_of(shingles: np.ndarray) -> np.ndarray:
    """How many shingles have each bit set."""
    pieces = [bits_of(shingles[k : k + PIECE]).sum(axis=0, dtype=np.int64) for k in range(0, len(shingles), PIECE)]
    return np.sum(pieces, axis=0) if pieces else np.zeros(64, np.int64)


def simhashes(shingles: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Fingerprints of the windows of span shingles that begin at first (ascending): bits that more than half of
    a window's shingles have set. A window that follows the one before by one shingle changes its counts by two."""
    out, count, before = [], None, -2
    for k in range(0, len(first), PIECE):
        piece = first[k : k + PIECE]
        cuts = np.flatnonzero(np.diff(piece) != 1) + 1
        for run in np.split(piece, cuts):
            if run[0] != before + 1:
                count = ones_of(shingles[run[0] : run[0] + span])
                steps = run[1:]
            else:
                steps = run
            change = bits_of(shingles[steps + span - 1]).astype(np.int64) - bits_of(shingles[steps - 1])
            counts = count + np.cumsum(change, axis=0) if len(steps) else np.zeros((0, 64), np.int64)
            counts = np.concatenate((count[None], counts)) if len(steps) < len(run) else counts
            wide = min(span, len(shingles) - int(run[0]))
            out.append(np.packbits(2 * counts > wide, axis=1, bitorder="little").view("<u8").ravel())
            count, before = counts[-1], int(run[-1])
    return np.concatenate(out).astype(U64) if out else np.zeros(0, U64)


def simhash(shingles: np.ndarray) -> int:
    return int(simhashes(shingles, np.zeros(1, np.int64), max(1, len(shingles)))[0])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger count of each shingle."""
    (p, m), (q, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(p, q, return_indices=True)
    low = int(np.minimum(m[i], n[j]).sum())
    return low / (int(m.sum()) + int(n.sum()) - low) if len(a) or len(b) else 0.0


class HammingIndex:
    """Items by the value of each eight-bit block, for all values within RADIUS // 8 bits of theirs."""

    def __init__(self, prints: list[int]):
        self.prints = np.array(prints, U64)
        near = [sum(1 << b for b in c) for r in range(RADIUS // BLOCK_BITS + 1) for c in combinations(range(BLOCK_BITS), r)]
        self.table: dict[int, list[int]] = {}
        for k, f in enumerate(prints):
            for block in range(64 // BLOCK_BITS):
                value = (f >> (block * BLOCK_BITS)) & 255
                for flip in near:
                    self.table.setdefault(block << 8 | (value ^ flip), []).append(k)
        self.table = {k: np.array(v, np.int32) for k, v in self.table.items()}

    def within(self, f: int) -> np.ndarray:
        found = [self.table.get(block << 8 | ((f >> (block * BLOCK_BITS)) & 255)) for block in range(64 // BLOCK_BITS)]
        found = [x for x in found if x is not None]
        if not found:
            return np.zeros(0, np.int32)
        at = np.unique(np.concatenate(found))
        return at[np.bitwise_count(self.prints[at] ^ U64(f)) <= RADIUS]


class Benchmark:
    """The items, by number of words, with their index and the shingles they hold."""

    def __init__(self, rows: list[tuple[int, str]], size: int = SIZE):
        hasher, self.size, by = WordHasher(), size, {}
        data, offsets = text_arrays(pa.array([t or "" for _, t in rows]))
        words, _, _, at = hasher.words(data[offsets[0] : offsets[-1]], offsets - offsets[0])
        for k, (item, _) in enumerate(rows):
            w = words[at[k] : at[k + 1]]
            if len(w):
                by.setdefault(len(w), []).append((item, item_shingles(w, size)))
        self.groups = {n: (HammingIndex([simhash(s) for _, s in g]), g) for n, g in sorted(by.items())}
        long = [s for n, g in by.items() if n >= size for _, s in g]
        self.known = np.unique(np.concatenate(long)) if long else np.zeros(0, U64)
        self.owners: dict[int, set[int]] = {}
        for n, g in by.items():
            for _, s in g if n >= size else ():
                for x in np.unique(s).tolist():
                    self.owners.setdefault(x, set()).add(n)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.known >> U64(44)).astype(np.int64)] = True
        self.short: dict[int, dict[int, list[int]]] = {n: {} for n in self.groups if n < size}  # all items of a text
        for n, m in self.short.items():
            for item, s in self.groups[n][1]:
                m.setdefault(int(s[0]), []).append(item)

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that some item holds."""
        at = np.flatnonzero(self.bits[(shingles >> U64(44)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return np.zeros(0, np.int64)
        s = shingles[at]
        return at[self.known[np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)] == s]

    def search(self, words: np.ndarray, shingles: np.ndarray, hits: np.ndarray, similarity: float) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, last word exclusive) of its best window in one document."""
        found: dict[int, tuple[float, int, int]] = {}
        sizes: dict[int, list[int]] = {}
        sizes_of: dict[int, int] = {}
        for p in hits.tolist():
            for n in self.owners[int(shingles[p])]:
                sizes.setdefault(n, []).append(p)
        for n, places in sizes.items():
            index, items = self.groups[n]
            span = n - self.size + 1  # shingles of a window
            # windows that hold a benchmark shingle are runs of first shingles, as long as the document at most
            at = np.unique(np.array(places))
            low, high = np.maximum(at - span + 1, 0), np.minimum(at, max(0, len(shingles) - span))
            low = np.maximum(low, np.concatenate(([0], high[:-1] + 1)))
            first = np.concatenate([np.arange(x, y + 1) for x, y in zip(low.tolist(), high.tolist(), strict=True) if x <= y] or [np.zeros(0, np.int64)])
            wide = np.minimum(first + span, len(shingles)) - first
            held = np.searchsorted(at, first + wide) - np.searchsorted(at, first)
            enough = held >= np.ceil(similarity / (1 + similarity) * (span + wide) - 1e-9)
            first, wide, held = first[enough], wide[enough], held[enough]
            prints, most = simhashes(shingles, first, span), held / (span + wide - held)
            # windows that can be most alike first: those that can't pass an item's best one are not compared
            for k in np.lexsort((first, -most)).tolist():
                a = int(first[k])
                for i in index.within(int(prints[k])).tolist():
                    item, own = items[i]
                    best = found.get(item, (0.0, -1))
                    if most[k] < best[0] or (most[k] == best[0] and a > best[1]):
                        continue
                    s = weighted_jaccard(shingles[a : a + span], own)
                    if s >= similarity and (s > best[0] or (s == best[0] and n == sizes_of.get(item) and a < best[1])):
                        found[item], sizes_of[item] = (s, a, min(a + n, len(words))), n
        return found


FOUND = {"items": pa.list_(pa.int64()), "similarities": pa.list_(pa.float64()), "firsts": pa.list_(pa.int64()), "lasts": pa.list_(pa.int64()), "spans": pa.list_(pa.int64())}


def _scan(shared, carried: list[str], text_col: str, similarity: float, size: int):
    @sparing
    def run(batches):
        bench = once(shared, lambda rows: Benchmark(rows, size))
        hasher = WordHasher()
        for batch in batches:
            for rows, data, begins in slices(np.arange(batch.num_rows), batch.column(text_col)):
                words, start, end, at = hasher.words(data, begins)
                shingles, cols = shingles_of(words, size), [[] for _ in FOUND]
                hit = bench.hits(shingles)
                few = [np.isin(item_shingles_of(words, n), np.array(list(m), U64)) for n, m in bench.short.items()]
                for k in range(len(rows)):
                    a, b = at[k], at[k + 1]
                    near = hit[np.searchsorted(hit, a) : np.searchsorted(hit, b - size + 1)] - a if b - a >= size else hit[:0]
                    found = bench.search(words[a:b], shingles[a : max(a, b - size + 1)], near, similarity) if len(near) else {}
                    for (n, m), is_in in zip(bench.short.items(), few, strict=True):
                        for p in np.flatnonzero(is_in[a : max(a, b - n + 1)]).tolist():
                            for item in m[int(item_shingles_of(words[a + p : a + p + n], n)[0])]:
                                found.setdefault(item, (1.0, p, p + n))
                    order = sorted(found)
                    base = begins[k]
                    for col, v in zip(cols, ([*order], [found[x][0] for x in order], [int(start[a + found[x][1]] - base) for x in order], [int(end[a + found[x][2] - 1] - base) for x in order], [found[x][2] - found[x][1] for x in order]), strict=True):
                        col.append(v)
                here = [batch.column(c).slice(int(rows[0]), len(rows)) for c in carried]
                yield pa.RecordBatch.from_arrays([*here, *[pa.array(c, t) for c, t in zip(cols, FOUND.values(), strict=True)]], names=[*carried, *FOUND])

    return run


def item_shingles_of(words: np.ndarray, n: int) -> np.ndarray:
    """Each run of n words, n below the shingle size, hashed as a whole item of n words is."""
    return mix(shingles_of(words, n), n) if len(words) >= n else np.zeros(0, U64)


def matched(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, size: int = SIZE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", items_at_once: int = ITEMS) -> DataFrame:
    """docs with items, similarities, firsts, lasts and spans; columns of docs with these names are replaced.

    items are the sorted ids of the benchmark items that some window of the document matches;
    similarities, firsts and lasts (bytes of the text, end exclusive) and spans (words) tell of
    the best window of each. Null, empty and wordless texts match nothing. Items without id or
    words match nothing; a repeated item id counts once, with its best window. The benchmark is read in
    rounds of items_at_once items, so the broadcast has a fixed bound; what rounds find is put
    together by text, so one row stays one row, whatever the ids. Without items nothing matches.
    """
    spark, docs = docs.sparkSession, docs.drop(*FOUND)
    items = keyed_text(benchmark, item_col, item_text).where("id is not null")
    rounds = max(1, -(-items.count() // items_at_once))
    found_type = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType() if n == "similarities" else T.LongType())) for n in FOUND])

    def shared(r: int):
        return spark.sparkContext.broadcast([tuple(x) for x in items.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).orderBy("id", "text").collect()])

    if rounds == 1:
        return docs.mapInArrow(_scan(shared(0), docs.columns, text_col, similarity, size), T.StructType([*docs.schema.fields, *found_type.fields]))
    key = lambda: F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    texts, part = docs.select(key().alias("key"), F.col(text_col).cast("string").alias("text")), None
    for r in range(rounds):
        out = texts.mapInArrow(_scan(shared(r), ["key"], "text", similarity, size), T.StructType([T.StructField("key", T.StringType()), *found_type.fields]))
        out = out.where(F.size("items") > 0).groupBy("key").agg(F.first(F.arrays_zip(*FOUND)).alias("found"))
        part = out if part is None else part.union(out)
    sorted_ = F.array_sort(F.flatten(F.collect_list("found")))
    part = part.groupBy("key").agg(sorted_.alias("found"))
    name, found = free_name("found_by_text", docs.columns), free_name("text_key", docs.columns)
    part = part.select(F.col("key").alias(found), F.col("found").alias(name))
    joined = docs.join(part, key() == F.col(found), "left")
    empty = lambda f: F.array().cast(f.dataType)
    return joined.select(*docs.columns, *[F.coalesce(F.col(name)[f.name], empty(f)).alias(f.name) for f in found_type.fields])


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", items_at_once: int = ITEMS) -> DataFrame:
    """(id, items, similarities, firsts, lasts, spans) of every row of docs, as `matched` finds them.

    Ids may be null or repeated: one row per row. Other columns are not read.
    """
    return matched(keyed_text(docs, id_col, text_col), benchmark, similarity, size, "text", item_col, item_text, items_at_once).drop("text")
