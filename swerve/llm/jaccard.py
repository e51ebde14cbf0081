"""N-gram Jaccard join by T-occurrence search.

A document of n distinct shingles can only be linked to one with which it shares at least
ceil(0.75 n) of them, and a pair of sizes n and m needs T = ceil(3/7 (n + m)). Shingles have one
global order, the most frequent ones last, and the inverted lists are dealt by shingle:

- A document stands in the lists of its first n - ceil(0.75 n) + 1 shingles, so partners meet in at
  least one. Lists of up to SHORT documents are merged in sorted order and the lists in which two
  documents meet are counted; a pair stays if this count and the lists not merged (longer ones, and
  those behind its first shingles) can reach T. What is left is probed by binary search.
- In longer lists each document is first compared to one leader for its class of sizes and one for
  the next. Members of a list that are then still in different components are searched block
  against block by DivideSkip: a query's short lists are merged by counting, its long lists are
  probed by binary search for the documents whose count can still reach T, and only links that
  join components leave a block. So no pairs of a list are made, and work on a list is cut into
  equal tasks.

What a document holds from a shingle on bounds the overlap of all pairs that have this shingle as
their first common one; members that can't reach anyone within this bound leave the list. With the same
long list before, two documents have been searched there. A list whose members all come from one
other list is left out for this reason.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Store, WordHasher, batch_of, free_name, keyed_text, mix, shingles_of, slices, sparing
from .graph import components, merged_labels

SIZE, NUM, DEN = 5, 75, 100
#: Postings that one bucket of the merge holds.
BUCKET = 1 << 18
#: Shingles counted together before only the repeated ones are passed on.
CHUNK = 1 << 20
#: The global order puts shingles counted so often last, at most so many of them (16 MB to each worker at
#: any size of the input). It only orders, so neither bound loses anything.
MOST_FREQUENT, FREQUENT = 1 << 20, 3
#: Lists up to this length are merged pair by pair, longer ones through leaders and blocks.
SHORT = 8
#: Documents on each side of a block, pairs with their sets that a Python worker gets at once.
BLOCK, BATCH_ROWS = 256, 256
#: Rows of blocks that a task's group holds about: small blocks are searched together; fewer with their sets.
MARK_ROWS, SET_ROWS = 4096, 512
#: Leaders are tried again while the blocks would compare more than so many pairs for each member of a list.
OPEN, LEADER_ROUNDS = 64, 3
#: DivideSkip's share of long lists (a constant of the published method).
MU = 0.0085
#: Slots of the bit table that tells which texts a join may need: 4 MB of bits at any size of the input.
SLOTS = 1 << 25


def sets_of(batches, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, sorted distinct shingle hashes) of each text. A text of 1 to size - 1 words is one shingle."""
    hasher = WordHasher()
    for batch in batches:
        ids = batch.column("id").to_pylist()
        for rows, data, begins in slices(np.arange(batch.num_rows), batch.column("text")):
            words, _, _, at = hasher.words(data, begins)
            shingles = shingles_of(words, size)
            for k, i in enumerate(rows.tolist()):
                a, b = at[k], at[k + 1]
                if b - a >= size:
                    s = np.sort(shingles[a : b - size + 1])
                    yield ids[i], s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
                elif b > a:
                    yield ids[i], mix(shingles_of(words[a:b], int(b - a)), int(b - a))
                else:
                    yield ids[i], np.zeros(0, U64)


def signature(s: np.ndarray) -> int:
    return int(mix(np.append(s, U64(len(s))), 3).sum(dtype=U64).astype(np.int64)) if len(s) else 0


def bitmap(s: np.ndarray) -> bytes:
    """Four to eight bits for each shingle, half of it beyond 1,024 shingles, one set by each: what one
    bitmap has and another lacks are shingles that the other set lacks, so a bound on the shared ones follows."""
    size = 1 << min(16, max(6, int((4 if len(s) <= 1024 else 2) * len(s) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[(s >> U64(40)).astype(np.int64) & (size - 1)] = True
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap as it is at a smaller size."""
    return np.bitwise_or.reduce(bits.reshape(-1, size // 8), axis=0)


def _bound(num: int, den: int):
    """Leave out pairs whose bitmaps prove that they can't reach the threshold."""
    schema = {k: pa.int64() for k in ("a", "b", "rep_a", "rep_b")}

    @sparing
    def run(batches):
        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            n_a, n_b = (cols[c].to_numpy() for c in ("n_a", "n_b"))
            keep = np.zeros(batch.num_rows, bool)
            for k, (p, q) in enumerate(zip(cols["bits_a"].to_pylist(), cols["bits_b"].to_pylist(), strict=True)):
                p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
                size = 8 * min(len(p), len(q))
                p, q = folded(p, size), folded(q, size)
                most = min(n_a[k] - int(np.bitwise_count(p & ~q).sum()), n_b[k] - int(np.bitwise_count(q & ~p).sum()))
                keep[k] = den * most >= num * (n_a[k] + n_b[k] - most)
            yield batch_of(schema, **{c: cols[c].to_numpy()[keep] for c in schema})

    return run


def _first_pass(size: int):
    schema = {"kind": pa.int32(), "a": pa.int64(), "n": pa.int64(), "b": pa.int64(), "bits": pa.binary()}

    @sparing
    def run(batches):
        kept, total, seen, rows = [], 0, set(), []

        def counts():
            h, c = np.unique(np.concatenate(kept), return_counts=True)
            return batch_of(schema, kind=np.ones((c > 1).sum(), np.int32), a=h[c > 1].view(np.int64), n=c[c > 1], b=np.zeros((c > 1).sum(), np.int64), bits=[None] * int((c > 1).sum()))

        for i, s in sets_of(batches, size):
            rows.append((i, len(s), sig := signature(s), bitmap(s) if len(s) else None))
            if sig not in seen and len(s):
                seen.add(sig)
                kept.append(s)
                total += len(s)
            if len(rows) == 8192:
                a, n, b, bits = zip(*rows, strict=True)
                yield batch_of(schema, kind=[0] * len(a), a=a, n=n, b=b, bits=bits)
                rows = []
            if total >= CHUNK:
                yield counts()
                kept, total, seen = [], 0, set()
        if rows:
            a, n, b, bits = zip(*rows, strict=True)
            yield batch_of(schema, kind=[0] * len(a), a=a, n=n, b=b, bits=bits)
        if kept:
            yield counts()

    return run


def ordered(s: np.ndarray, hot: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles in the global order and how many of them are not among the frequent ones."""
    if not len(hot):
        return s, len(s)
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[at] == s
    if not is_hot.any():
        return s, len(s)
    late = at[is_hot]
    return np.concatenate([s[~is_hot], hot[late[np.lexsort((hot[late], df[late]))]]]), int(len(s) - len(late))


def short_lists(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _second_pass(size: int, num: int, den: int, buckets: int, shared):
    schema = {"bucket": pa.int32(), "h": pa.list_(pa.int64()), "s": pa.list_(pa.int64()), "left": pa.list_(pa.int32())}

    @sparing
    def run(batches):
        hot, df = shared.value
        cold_h, cold_s, cold_n, cold_left, hot_h, hot_s, hot_n, hot_left, total, seen = [], [], [], [], [], [], [], [], 0, set()

        def out():
            at, h, s, left = [], [], [], []
            if cold_h:
                all_h, all_s, all_left = np.concatenate(cold_h), np.repeat(np.array(cold_s, np.int64), cold_n), np.concatenate(cold_left)
                bucket = ((all_h >> U64(32)) * U64(buckets)) >> U64(32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U64))
                for k in np.flatnonzero(np.diff(cuts)):
                    part = order[cuts[k] : cuts[k + 1]]
                    at.append(int(k)), h.append(all_h[part].view(np.int64)), s.append(all_s[part]), left.append(all_left[part])
            if hot_h:  # passed on as they are; their groups are cut by where they come from
                at.append(buckets + int(seen_first % 1_000_003)), h.append(np.concatenate(hot_h).view(np.int64)), s.append(np.repeat(np.array(hot_s, np.int64), hot_n)), left.append(np.concatenate(hot_left))
            return batch_of(schema, bucket=at, h=h, s=s, left=left)

        seen_first = 0
        for _, u in sets_of(batches, size):
            if not len(u) or (sig := signature(u)) in seen:
                continue
            seen_first = seen_first or abs(sig)
            seen.add(sig)
            p = short_lists(len(u), num, den)
            u, cold = ordered(u, hot, df)
            left = np.arange(len(u), len(u) - p, -1, dtype=np.int32)  # shingles from each one on
            if k := min(p, cold):
                cold_h.append(u[:k]), cold_s.append(sig), cold_n.append(k), cold_left.append(left[:k])
            if p > cold:
                hot_h.append(u[cold:p]), hot_s.append(sig), hot_n.append(p - cold), hot_left.append(left[cold:])
            total += p
            if total >= CHUNK // 2:
                yield out()
                cold_h, cold_s, cold_n, cold_left, hot_h, hot_s, hot_n, hot_left, total, seen, seen_first = [], [], [], [], [], [], [], [], 0, set(), 0
        if total:
            yield out()

    return run


def _merge(buckets: int):
    """One bucket of short lists: pairs that meet in lists of 2 to SHORT documents, with the number of
    lists in which they do (`left`), and members of longer lists."""
    schema = {"kind": pa.int32(), "x": pa.int64(), "y": pa.int64(), "left": pa.int32()}

    def run(key, group):
        h, s, left = (np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in group.column(c).chunks]) for c in ("h", "s", "left"))
        if key[0].as_py() >= buckets:
            return pa.Table.from_batches([batch_of(schema, kind=np.ones(len(h), np.int32), x=h, y=s, left=left)])
        order = np.lexsort((s, h))
        h, s, left = h[order], s[order], left[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s, left = h[keep], s[keep], left[keep]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        length = np.diff(np.append(start, len(h)))
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(2, SHORT + 1):
            of = start[length == m]
            for i in range(m if len(of) else 0):
                for j in range(i + 1, m):
                    x.append(s[of + i]), y.append(s[of + j])
        x, y = np.concatenate(x), np.concatenate(y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        met = np.diff(np.append(np.flatnonzero(new), len(x))).astype(np.int32)
        long = np.repeat(length > SHORT, length)
        kind = np.concatenate([np.zeros(new.sum(), np.int32), np.ones(long.sum(), np.int32)])
        return pa.Table.from_batches([batch_of(schema, kind=kind, x=np.concatenate([x[new], h[long]]), y=np.concatenate([y[new], s[long]]), left=np.concatenate([met, left[long]]))])

    return run


def _as_sets(size: int):
    schema = {"sig": pa.int64(), "set": pa.list_(pa.int64())}

    @sparing
    def run(batches):
        sigs, sets, total = [], [], 0
        for _, s in sets_of(batches, size):
            sigs.append(signature(s)), sets.append(s.view(np.int64))
            total += len(s)
            if total > 1 << 19:
                yield batch_of(schema, sig=sigs, set=sets)
                sigs, sets, total = [], [], 0
        if sigs:
            yield batch_of(schema, sig=sigs, set=sets)

    return run


def _count(num: int, den: int):
    """Keep the pairs whose shared shingles, counted by probing one set in the other, reach the threshold."""
    schema = {"a": pa.int64(), "b": pa.int64()}

    @sparing
    def run(batches):
        for batch in batches:
            sides = []
            for c in ("set_a", "set_b"):
                col = batch.column(c)
                values, offsets = col.values.to_numpy(zero_copy_only=False).view(U64), col.offsets.to_numpy()
                sides.append([values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
            keep = np.zeros(batch.num_rows, bool)
            for k, (p, q) in enumerate(zip(*sides, strict=True)):
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                shared = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep[k] = den * shared >= num * (len(p) + len(q) - shared)
            yield batch_of(schema, a=batch.column("a").to_numpy()[keep], b=batch.column("b").to_numpy()[keep])

    return run


class Lists:
    """The inverted lists of a block of sets: for each shingle the ascending places of those that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        h, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.lexsort((who, h))
        h, self.who, self.size = h[order], who[order], len(sets)
        self.begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        self.key, self.end = h[self.begin], np.append(self.begin[1:], len(h)) if len(h) else self.begin

    def search(self, query: np.ndarray, need: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Open places that hold at least need[place] of the query's shingles, by DivideSkip.

        The longest lists are set aside. The others are merged by counting (what a heap of their
        heads gives, in one pass); a place stays if the long lists could still lift its count to
        what it needs, and is probed in them by binary search until they can't.
        """
        at = np.searchsorted(self.key, query)
        at = at[self.key[np.minimum(at, len(self.key) - 1)] == query] if len(self.key) else at[:0]
        least = int(need[open_].min()) if open_.any() else 1
        if len(at) < least:
            return at[:0]
        begin, length = self.begin[at], self.end[at] - self.begin[at]
        order = np.argsort(length, kind="stable")
        begin, length = begin[order], length[order]
        n_long = min(least - 1, int(least / (MU * math.log2(max(2, int(length[-1]))) + 1)))
        n_short = len(at) - n_long
        run, total = length[:n_short], int(length[:n_short].sum())
        merged = self.who[np.repeat(begin[:n_short] - np.concatenate(([0], np.cumsum(run)[:-1])), run) + np.arange(total)]
        count = np.bincount(merged, minlength=self.size)
        cand = np.flatnonzero(open_ & (count >= need - n_long))
        for k in range(n_short, len(at)):
            if not len(cand):
                break
            places = self.who[begin[k] : begin[k] + length[k]]
            count[cand] += places[np.minimum(np.searchsorted(places, cand), len(places) - 1)] == cand
            cand = cand[count[cand] + (len(at) - 1 - k) >= need[cand]]
        return cand[count[cand] >= need[cand]]


class Block:
    """The queries and targets of one pair of blocks, and which of them may still be linked."""

    def __init__(self, group: pa.Table, num: int, den: int):
        col = lambda c: group.column(c).to_numpy()
        self.num, self.den, self.sig, self.n, self.left = num, den, col("sig"), col("n"), col("left")
        self.before, self.none = group.column("before").fill_null(0).to_numpy(), group.column("before").is_null().to_numpy()
        self.part = np.unique(col("label"), return_inverse=True)[1]
        self.q, self.t = np.flatnonzero(~col("target")), np.flatnonzero(col("target"))

    def need(self, q: int) -> np.ndarray:
        return -(-self.num * (self.n[self.t] + self.n[q]) // (self.num + self.den))

    def open(self, q: int, need: np.ndarray) -> np.ndarray:
        t = self.t
        reach = (np.minimum(self.left[t], self.left[q]) >= need) & (np.minimum(self.n[t], self.n[q]) >= need)
        return reach & (self.part[t] != self.part[q]) & (self.none[t] | self.none[q] | (self.before[t] != self.before[q]))


def _blocks_of(table: pa.Table) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(places, rows) of each pair of blocks in a group of rows."""
    key = table.column("block").to_numpy()
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True]))) if len(key) else []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield order[i:j], table.take(pa.array(order[i:j])).combine_chunks()


def _mark_blocks(num: int, den: int):
    """The rows of pairs of blocks whose bitmaps allow them an open partner."""

    def run(key, group):
        kept = np.zeros(group.num_rows, bool)
        slim, column = group.drop_columns(["bits"]), group.column("bits").combine_chunks()
        for places, rows in _blocks_of(slim):
            block = Block(rows, num, den)
            if not len(block.q) or not len(block.t):
                continue
            bits = [np.frombuffer(column[int(k)].as_buffer(), np.uint8) for k in places]
            size = 8 * min(map(len, bits))
            theirs, keep = np.stack([folded(bits[k], size) for k in block.t]), np.zeros(len(places), bool)
            for q in block.q.tolist():
                need = block.need(q)
                at = np.flatnonzero(block.open(q, need))
                if len(at):
                    own, other = folded(bits[q], size), theirs[at]
                    most = np.minimum(block.n[q] - np.bitwise_count(own & ~other).sum(axis=1, dtype=np.int64), block.n[block.t[at]] - np.bitwise_count(other & ~own).sum(axis=1, dtype=np.int64))
                    at = at[most >= need[at]]
                    keep[block.t[at]] = True
                    keep[q] |= len(at) > 0
            kept[places[keep]] = True
        return slim.filter(pa.array(kept))

    return run


def _search_blocks(num: int, den: int):
    """Links that join components between the queries and the targets of pairs of blocks."""
    schema = {"a": pa.int64(), "b": pa.int64()}

    def run(key, group):
        a, b = [], []
        for _, rows in _blocks_of(group):
            sets = rows.column("set").combine_chunks()
            values, offsets = sets.values.to_numpy(zero_copy_only=False).view(U64), sets.offsets.to_numpy()
            of = [values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            block = Block(rows, num, den)
            part, t = block.part, block.t
            lists = Lists([of[k] for k in t]) if len(t) else None
            for q in block.q.tolist() if lists else ():
                need = block.need(q)
                for k in lists.search(of[q], need, block.open(q, need)).tolist():
                    if part[t[k]] != part[q]:
                        part[part == part[t[k]]] = part[q]
                        a.append(int(block.sig[q])), b.append(int(block.sig[t[k]]))
        return pa.Table.from_batches([batch_of(schema, a=a, b=b)])

    return run


def _place_of(key: Column) -> tuple[Column, Column]:
    """The word of the bit table that tells of a key, and the key's bit in it."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    return F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))


def split_by(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows of docs whose id is surely not in ids(id), and those that may be in it; a null id is in neither. A bit
    table of ids, of at most SLOTS bits, is broadcast, so that a join need not shuffle the first ones."""
    word, bit = _place_of(F.col("id"))
    at, bits = free_name("word", docs.columns), free_name("bits", docs.columns)
    table = ids.groupBy(word.alias(at)).agg(F.bit_or(bit).alias(bits))
    word, bit = _place_of(F.col(id_col).cast("long"))
    rows = docs.where(F.col(id_col).isNotNull()).join(F.broadcast(table), word == F.col(at), "left")
    held = F.coalesce(F.col(bits), F.lit(0).cast("long")).bitwiseAND(bit) != 0
    return rows.where(~held).select(*docs.columns), rows.where(held).select(*docs.columns)


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of texts whose id is in wanted(id), which holds an id once. A bit table of the wanted ids, of
    at most SLOTS bits, is broadcast first, so that nearly no other text is shuffled for the exact join."""
    word, bit = _place_of(F.col("id"))
    table = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return texts.join(F.broadcast(table), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).select(*texts.columns).join(wanted, "id")


def _long_lists(members: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(h, sig, left, n, k, before) of the long lists and (sig, n_long) of all documents in them.

    `before` is the document's long list just before h, k the class of its size: sizes whose ratio allows a
    link are in one class or in neighbours. Lists whose members all have the same list before are
    left out: their pairs stand in that one.
    """
    by_doc = Window.partitionBy("sig").orderBy(F.desc("left"))
    members = members.repartition("sig").dropDuplicates(["sig", "h", "left"]).withColumn("before", F.lag("h").over(by_doc))
    members = store.put(members, "members")
    inner = members.groupBy("h").agg(F.min("before").alias("lo"), F.max("before").alias("hi"), F.count("before").alias("k"), F.count(F.lit(1)).alias("m")).where("lo = hi and k = m")
    return members.join(inner.select("h"), "h", "left_anti"), members.groupBy("sig").agg(F.count(F.lit(1)).alias("n_long"))


def _leaders(lists: DataFrame, store: Store) -> DataFrame:
    """(x, y): each member of a long list with the leader of its class of sizes and of the next. A class is
    led by the member with the largest share of its shingles from the list on."""
    lead = store.put(lists.groupBy("h", "k").agg(F.max_by("sig", F.struct(F.col("left") / F.col("n"), F.xxhash64("sig"))).alias("x")), "leaders")
    return lists.select("h", F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("k"), F.col("sig").alias("y")).join(lead, ["h", "k"]).select("x", "y")


def _open_sides(lists: DataFrame, label: DataFrame, store: Store, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, targets and their numbers by (h, kq, kt): who is left to be compared in the long lists.

    Queries are the members outside the list's largest component, targets all members of a class of
    sizes in reach; both only as far as the shingles from the list on allow a link.
    """
    now = lists.join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    now = store.put(now.select("h", "k", "sig", "n", "left", "before", "label"), "now")
    main = now.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("h", "main")
    rest = store.put(now.join(main, "h"), "rest")
    reach = lambda least: (num + den) * F.col("left") >= num * (F.col("n") + F.col(least))
    sizes = rest.groupBy("h", F.col("k").alias("kt")).agg(F.min("n").alias("least_t"))
    q = rest.where("label != main").withColumn("kt", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1))).join(sizes, ["h", "kt"]).where(reach("least_t"))
    q = store.put(q.select("h", F.col("k").alias("kq"), "kt", "sig", "n", "left", "before", "label"), "queries")
    nq = q.groupBy("h", "kq", "kt").agg(F.count(F.lit(1)).alias("nq"), F.min("n").alias("least_q"))
    t = rest.withColumnRenamed("k", "kt").join(nq, ["h", "kt"]).where(reach("least_q"))
    t = store.put(t.select("h", "kq", "kt", "sig", "n", "left", "before", "label", "nq"), "targets")
    return q, t, store.put(t.groupBy("h", "kq", "kt").agg(F.first("nq").alias("nq"), F.count(F.lit(1)).alias("nt")), "sizes")


def _block_rows(q: DataFrame, t: DataFrame, sizes: DataFrame) -> DataFrame:
    """Both sides dealt into blocks of about BLOCK documents, a row for each block of the other side."""
    key = ["h", "kq", "kt"]
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("sig", F.lit(1)), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    cols = [*key, "sig", "n", "left", "before", "label"]
    q = q.join(sizes, key).select(*cols, F.lit(False).alias("target"), own("nq").alias("bq"), each("nt").alias("bt"))
    t = t.drop("nq").join(sizes, key).select(*cols, F.lit(True).alias("target"), own("nt").alias("bt"), each("nq").alias("bq"))
    rows = q.unionByName(t)
    return rows.select(F.xxhash64(*key, "bq", "bt").alias("block"), "sig", "n", "left", "before", "label", "target")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs.

    Documents link when den * shared shingles >= num * united shingles; a component's id is the
    smallest document id in it. Null or empty text, or text without words: no shingles, linked
    with nothing, its own component. Rows with equal sets are one class from the start, so copies
    are never paired. A repeated id gives one row per input row. A row with a null id stays, links
    nobody and has the component of the rows with its shingles, null where there are none. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    store, texts = Store(spark), keyed_text(docs, id_col, text_col)
    scan = store.put(texts.mapInArrow(_first_pass(size), "kind int, a long, n long, b long, bits binary"), "scan")
    sets = scan.where("kind = 0").select(F.col("a").alias("id"), F.col("n").alias("n_shingles"), F.col("b").alias("sig"), "bits")
    width = math.log(den / num * 1.0001)
    reps = sets.where("n_shingles > 0 and id is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    reps = store.put(reps.withColumn("k", F.floor(F.log("n") / width).cast("int")), "reps")
    frequent = scan.where("kind = 1").groupBy("a").agg(F.sum("n").alias("c")).where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "a").limit(MOST_FREQUENT).toPandas()
    hot, df = frequent["a"].to_numpy(np.int64).view(U64), frequent["c"].to_numpy(np.int64)
    order = np.argsort(hot)
    shared = spark.sparkContext.broadcast((hot[order], df[order]))
    postings = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (den - num) / den
    buckets = max(8, math.ceil(postings / BUCKET))

    packed = texts.where("id is not null").mapInArrow(_second_pass(size, num, den, buckets, shared), "bucket int, h array<long>, s array<long>, left array<int>")
    merged = store.put(packed.groupBy("bucket").applyInArrow(_merge(buckets), "kind int, x long, y long, left int"), "merged")
    lists, n_long = _long_lists(merged.where("kind = 1").select(F.col("x").alias("h"), F.col("y").alias("sig"), "left"), store)
    lists, n_long = store.put(lists.join(reps.select("sig", "n", "k"), "sig"), "lists"), store.put(n_long, "n_long")

    def paired(pairs: DataFrame) -> DataFrame:
        """Distinct pairs a < b of pairs(x, y, met) that may reach T. met: lists merged in which they meet,
        null for a pair with a leader."""
        pairs = pairs.where("x != y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("met").alias("met"), F.max(F.col("met").isNull()).alias("led"))
        of = lambda k, *more: reps.select(F.col("sig").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in more])
        longs = lambda k: n_long.select(F.col("sig").alias(k), F.col("n_long").alias(f"long_{k}"))
        pairs = pairs.join(of("a", "n"), "a").join(of("b", "n"), "b").where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
        pairs = pairs.join(longs("a"), "a", "left").join(longs("b"), "b", "left")
        need, behind = F.ceil((F.col("n_a") + F.col("n_b")) * num / (num + den) - 1e-9), F.ceil(F.greatest("n_a", "n_b") * num / den - 1e-9) - 1
        not_merged = behind + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0)))
        pairs = pairs.where(F.col("led") | (F.col("met") + not_merged >= need)).select("a", "b", "n_a", "n_b")
        pairs = pairs.join(of("a", "rep", "bits"), "a").join(of("b", "rep", "bits"), "b")  # wide columns only for what counts leave
        return pairs.mapInArrow(_bound(num, den), "a long, b long, rep_a long, rep_b long")

    def full_sets(wanted: DataFrame) -> DataFrame:
        """(sig, set) of the documents whose ids are in wanted(id)."""
        return store.put(_texts_of(texts, wanted.distinct()).mapInArrow(_as_sets(size), "sig long, set array<long>"), "sets")

    def linked(cand: DataFrame) -> DataFrame:
        full = full_sets(cand.select(F.col("rep_a").alias("id")).union(cand.select(F.col("rep_b").alias("id"))))
        both = cand.select("a", "b").join(full.select(F.col("sig").alias("b"), F.col("set").alias("set_b")), "b")
        both = both.join(full.select(F.col("sig").alias("a"), F.col("set").alias("set_a")), "a")
        return both.mapInArrow(_count(num, den), "a long, b long")

    def searched(q: DataFrame, t: DataFrame, sizes: DataFrame) -> DataFrame:
        """Links of the blocks; sets are only sent for what bitmaps leave. Small blocks share a group."""
        rows = store.put(_block_rows(q, t, sizes), "blocks")
        dealt = lambda df, n, size: df.groupBy(F.pmod(F.xxhash64("block"), F.lit(max(8, math.ceil(n / size)))))
        marked = rows.join(reps.select("sig", "bits"), "sig").select(*rows.columns, "bits")
        marked = store.put(dealt(marked, rows.count(), MARK_ROWS).applyInArrow(_mark_blocks(num, den), rows.schema), "marked")
        full = full_sets(marked.select("sig").distinct().join(reps, "sig").select(F.col("rep").alias("id")))
        return store.put(dealt(marked.join(full, "sig"), marked.count(), SET_ROWS).applyInArrow(_search_blocks(num, den), "a long, b long"), "found")

    pairs = merged.where("kind = 0").select("x", "y", F.col("left").alias("met")).unionByName(_leaders(lists, store).withColumn("met", F.lit(None).cast("int")))
    n_members, label = lists.count(), None
    for round_ in range(LEADER_ROUNDS):
        found = store.put(linked(store.put(paired(pairs), "pairs")), "found", batch_rows=BATCH_ROWS)
        label = components(store, found) if label is None else merged_labels(store, label, found)
        if not n_members:
            break
        q, t, sizes = _open_sides(lists, label, store, num, den)
        still = sizes.agg(F.sum(F.col("nq") * F.col("nt"))).first()[0] or 0
        if round_ == LEADER_ROUNDS - 1 or still <= OPEN * n_members:
            if still:  # exact for all that leaders left open
                label = merged_labels(store, label, searched(q, t, sizes))
            break
        lead = F.struct(F.col("left") / F.col("n"), F.xxhash64("sig", F.lit(round_)))
        lead_q, lead_t = (side.groupBy("h", "kq", "kt").agg(F.max_by("sig", lead).alias("x")) for side in (q, t))
        pairs = t.join(lead_q, ["h", "kq", "kt"]).select("x", F.col("sig").alias("y")).union(q.join(lead_t, ["h", "kq", "kt"]).select("x", F.col("sig").alias("y"))).withColumn("met", F.lit(None).cast("int"))

    group = reps.join(label.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", F.coalesce("label", "sig").alias("label"))
    smallest = group.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_sig = group.join(smallest, "label").select("sig", "component_id")
    return sets.join(of_sig, "sig", "left").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
