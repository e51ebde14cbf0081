"""Links between the tokens of two vocabularies, by inverted bitmaps of token pairs.

Both token sequences cover the same bytes; where tokens of both end at one byte, they are cut into groups, and each
occurrence of an A token is linked to each occurrence of a B token of its group. A task numbers its documents
in chunks of 65,536 and inverts their links: for each pair of ids and each binary digit of the number of
links that a document has of the pair (a plane), a compressed bitmap of documents. Bitmaps of one pair, chunk and plane are OR-merged;
the pair's documents are counted over the OR of its planes, its links over the planes by their values. Scores go
back the same way: a pair's bitmaps give its count to their documents, chunk by chunk.

Neither vocabulary's tokens cross the border between a word and white space or signs behind it, so a text is cut there and each
distinct segment is encoded and aligned once by a worker, thousands at a time by arrays over all their tokens. That the files allow it is looked up in their vocabularies;
texts with other white space, and files that don't allow it, are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .common import Store, batch_of, give_back, sparing

#: Pairs that a task gathers before it writes their bitmaps, and characters of texts that it cuts at once: these bound its memory.
LINKS, CHARACTERS = 1 << 21, 1 << 19
#: Segments, and characters of one, that a worker remembers.
KNOWN, LONGEST = 1 << 19, 64
#: A pair's chunks are dealt to so many join keys, so that a pair of all documents isn't one task.
SALTS = 32
#: Bitmaps of a batch that are decoded at once.
GROUP = 4096
LETTER, SIGN = "a-zA-ZÀ-ÖØ-öø-ÿ", r"!-/:-@\[-^`{-~"
#: White space with the word after it, cut again between a letter and a sign behind it.
SEGMENT = re.compile(rf"[ \n\t]{{2,}}[^ \n\t]*| ?[{LETTER}]++(?![^{SIGN} \n\t])| ?[^ \n\t]+?(?:(?<=[{LETTER}])(?=[{SIGN}])|(?![^ \n\t]))| |[\n\t]")
OTHER_SPACE = re.compile(r"[^\S \n\t]")

#: In place of a segment's number: not encoded yet, and bytes of its A and B tokens that differ.
UNKNOWN, DIFFERS = -1, -2

_state: dict = {}


def byte_of_character() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def longer(x: np.ndarray, n: int) -> np.ndarray:
    """x with zeros behind it; those take memory when they are written."""
    out = np.zeros((n, *x.shape[1:]), x.dtype)
    out[: len(x)] = x
    return out


class Aligner:
    """Both vocabularies, and what they make of segments and texts."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        of = byte_of_character()
        self.a_bytes = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        n_a, self.n_b = max(self.a_bytes) + 1, len(pieces)
        self.a_size, self.b_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(n_a)]), np.array([len(p) for p in self.b_bytes])
        self.step = max(n_a, self.n_b)
        #: Ids as text with what follows them: a token of the same side, the other side, a group, a segment.
        self.names = [f"{i}{c}" for c in ",|;\n" for i in range(self.step)]
        own = json.loads(self.a.to_str())
        pre = own.get("pre_tokenizer") or {}
        plain = own.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        odd = " ▁\n \t▁▁xｘ ½\n\n"
        whole = self.b.decode(self.b.encode(odd)) == odd.replace("▁", " ") and self.b.encode("\n", out_type=str) == ["▁", "<0x0A>"]
        self.cuts = plain and whole and not any(re.search(rf".[▁\n\t]|[\n\t].|[{LETTER}][{SIGN}]", p.lstrip("▁"), re.S) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        self.space = self.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        """Segments have numbers; size and held say how many segments and pairs the arrays hold."""
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.size = self.held = 0
        self.counts, self.begins = np.zeros((1024, 4), np.int64), np.zeros(1025, np.int64)
        self.pairs, self.times = np.zeros(4096, np.int64), np.zeros(4096, np.int64)

    def keep(self, size: int) -> None:
        """Drops the segments from that number on."""
        del self.groups[size:]
        self.size, self.held = size, int(self.begins[size])

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments as they stand in a text: the library puts a space before what it encodes."""
        out = self.b.encode([s[1:] if s[0] == " " else f"\n{s}" for s in segments], num_threads=1)
        return [([self.space] if s == " " else ids) if s[0] == " " else ids[2:] for s, ids in zip(segments, out, strict=True)]

    def encode_a(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]

    def add(self, a: list[list[int]], b: list[list[int]]) -> list[int]:
        """Aligns the ids of segments; the number of each, DIFFERS where the bytes of a and b differ."""
        left, right = (b"".join(map(of.__getitem__, chain.from_iterable(x))) for of, x in ((self.a_bytes, a), (self.b_bytes, b)))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        a_cut, b_cut = (np.append(0, end)[np.append(0, np.cumsum(n))] for end, n in ((a_end, n_a), (b_end, n_b)))
        if left != right or (a_cut != b_cut).any():
            if len(a) == 1:
                return [DIFFERS]
            fits = [left[p:q] == right[r:s] for p, q, r, s in zip(a_cut[:-1].tolist(), a_cut[1:].tolist(), b_cut[:-1].tolist(), b_cut[1:].tolist(), strict=True)]
            found = iter(self.add(list(compress(a, fits)), list(compress(b, fits))) if any(fits) else [])
            return [next(found) if x else DIFFERS for x in fits]

        ends = np.zeros(len(left) + 1, np.int8)  # bytes where tokens of A (1) and of B (2) end
        ends[a_end] = 1
        ends[b_end] += 2
        a_last, b_last = ends[a_end] == 3, ends[b_end] == 3
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        k_a, k_b = np.bincount(a_group), np.bincount(b_group)
        a_first, b_first = np.cumsum(k_a) - k_a, np.cumsum(k_b) - k_b
        links = k_a * k_b
        segment = np.repeat(np.arange(len(a)), n_a)[a_first]

        some = np.flatnonzero(links <= 64)
        n = links[some]
        group = np.repeat(some, n)
        p, q = np.divmod(np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n), k_b[group])
        pairs, times, owner = a_ids[a_first[group] + p] * self.n_b + b_ids[b_first[group] + q], np.ones(len(group), np.int64), segment[group]
        many = np.flatnonzero(links > 64)
        if len(many):  # many tokens: by distinct ids
            more = []
            for g in many.tolist():
                p, p_n = np.unique(a_ids[a_first[g] : a_first[g] + k_a[g]], return_counts=True)
                q, q_n = np.unique(b_ids[b_first[g] : b_first[g] + k_b[g]], return_counts=True)
                more.append(((p[:, None] * self.n_b + q).ravel(), (p_n[:, None] * q_n).ravel(), np.full(len(p) * len(q), segment[g])))
            pairs, times, owner = (np.concatenate(x) for x in zip((pairs, times, owner), *more, strict=True))
            order = np.argsort(owner, kind="stable")
            pairs, times, owner = pairs[order], times[order], owner[order]

        name = np.empty(len(a_ids) + len(b_ids), np.int64)  # a group's A tokens, then its B tokens
        name[np.arange(len(a_ids)) + b_first[a_group]] = a_ids + self.step * a_last
        b_after = 2 * b_last
        b_after[np.cumsum(n_b) - 1] = 3
        name[np.arange(len(b_ids)) + (a_first + k_a)[b_group]] = b_ids + self.step * b_after
        self.groups += "".join(map(self.names.__getitem__, name.tolist()))[:-1].split("\n")

        size, held = self.size + len(a), self.held + len(pairs)
        if size > len(self.counts):
            self.counts, self.begins = longer(self.counts, 2 * size), longer(self.begins, 2 * size + 1)
        if held > len(self.pairs):
            self.pairs, self.times = longer(self.pairs, 2 * held), longer(self.times, 2 * held)
        self.counts[self.size : size] = np.stack([n_a, n_b, np.bincount(segment), np.add.reduceat(links, np.flatnonzero(np.diff(segment, prepend=-1)))], 1)
        self.begins[self.size + 1 : size + 1] = self.held + np.cumsum(np.bincount(owner))
        self.pairs[self.held : held], self.times[self.held : held] = pairs, times
        out = list(range(self.size, size))
        self.size, self.held = size, held
        return out

    def learn(self, segments: list[str], known: dict[str, int]) -> None:
        for k in range(0, len(segments), 4096):
            some = segments[k : k + 4096]
            known.update(zip(some, self.add(self.encode_a(some), self.encode_b(some)), strict=True))

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the segments of " " + text, how many each text has (none: no tokens), and the size to keep afterwards."""
        cuts = [SEGMENT.findall(f" {t}") if t and self.cuts and not OTHER_SPACE.search(t) else [] for t in texts]
        flat = list(chain.from_iterable(cuts))
        numbers = np.fromiter(map(self.known.get, flat, repeat(UNKNOWN)), np.int64, len(flat))
        missing = np.flatnonzero(numbers == UNKNOWN)
        new = dict.fromkeys([flat[k] for k in missing.tolist()])
        self.learn([s for s in new if len(s) <= LONGEST], self.known)
        size, long = self.size, {}
        for s in new:
            if len(s) > LONGEST:
                self.learn([s], long)
        for k in missing.tolist():
            numbers[k] = long[flat[k]] if flat[k] in long else self.known[flat[k]]
        n = np.fromiter(map(len, cuts), np.int64, len(cuts))
        bad = np.append(0, np.cumsum(numbers == DIFFERS))
        end = np.cumsum(n)
        whole = [k for k in np.flatnonzero((n == 0) | (bad[end] > bad[end - n])).tolist() if texts[k]]
        if whole:
            parts = np.split(numbers, end[:-1])
            for k in whole:
                parts[k] = np.array([x for x in self.add(self.encode_a([f" {texts[k]}"]), [self.b.encode(texts[k])]) if x != DIFFERS], np.int64)
            numbers, n = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return numbers, n, size


def aligner(a_path: str, b_path: str) -> Aligner:
    if _state.get("paths") != (a_path, b_path):
        _state.update(paths=(a_path, b_path), made=Aligner(a_path, b_path))
    return _state["made"]


SCAN = {"row": pa.int64(), "id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "a": pa.int32(), "b": pa.int32(), "chunk": pa.int64(), "plane": pa.int32(), "dense": pa.bool_(), "bits": pa.binary()}
SCAN_DDL = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, chunk long, plane int, dense boolean, bits binary"


def filled(n: int, **columns) -> pa.RecordBatch:
    """A batch of SCAN with nulls in the columns that aren't given."""
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in SCAN.items()], names=list(SCAN))


def inverted(n_b: int, chunk: int, keys: list, times: list) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the links gathered: arrays of (a * n_b + b) << 16 | document in the chunk, and of links. The lists are emptied."""
    key, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, times))
    keys.clear()
    times.clear()
    if not len(key):
        return
    order = np.argsort(key)
    key, n = key[order], n[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, n = key[first], np.add.reduceat(n, first)
    for plane in range(int(n.max()).bit_length()):
        some = key[(n >> plane) & 1 == 1]
        if len(some):
            owner = some >> 16
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            bits, dense = bitmaps.encode(some & 0xFFFF, begins)
            a, b = np.divmod(owner[begins], n_b)
            yield filled(len(begins), a=a.astype(np.int32), b=b.astype(np.int32), chunk=np.full(len(begins), chunk), plane=np.full(len(begins), plane, np.int32), dense=dense, bits=bits)


def _scan(a_path: str, b_path: str, most: int):
    def run(batches):
        made, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        keys, times, n_gathered = [], [], 0

        for batch in batches:
            ids, texts = batch.column("id"), [t or "" for t in batch.column("text").to_pylist()]
            k = 0
            while k < len(texts):
                end, size = k, 0
                while end < len(texts) and (end == k or size + len(texts[end]) <= min(most, CHARACTERS) and (row + end - k) & 0xFFFF):
                    size += len(texts[end])
                    end += 1
                numbers, n, kept = made.numbered(texts[k:end])
                rows = np.arange(row, row + end - k)
                sums = np.zeros((len(numbers) + 1, 4), np.int64)
                np.cumsum(made.counts[numbers], axis=0, out=sums[1:])
                stop = np.cumsum(n)
                sums = sums[stop] - sums[stop - n]
                groups = list(map(made.groups.__getitem__, numbers.tolist()))
                hashes = [hashlib.sha256(";".join(groups[e - m : e]).encode()).hexdigest() if m else "" for e, m in zip(stop.tolist(), n.tolist(), strict=True)]
                begins, pairs = made.begins[numbers], made.begins[numbers + 1] - made.begins[numbers]
                at = np.repeat(begins - np.cumsum(pairs) + pairs, pairs) + np.arange(pairs.sum())
                keys.append(made.pairs[at] << 16 | np.repeat(np.repeat(rows & 0xFFFF, n), pairs))
                times.append(made.times[at])
                n_gathered += len(at)
                yield filled(len(rows), row=rows, id=ids.slice(k, end - k), n_a=sums[:, 0], n_b=sums[:, 1], n_groups=sums[:, 2], n_links=sums[:, 3], groups_sha256=hashes)
                row, k = row + end - k, end
                made.keep(kept)
                if made.size >= KNOWN:
                    made.forget()
                if n_gathered > most or not row & 0xFFFF:
                    yield from inverted(made.n_b, (row - 1) >> 16, keys, times)
                    n_gathered = 0
                    give_back()
        yield from inverted(made.n_b, (row - 1) >> 16, keys, times)

    return sparing(run)


MERGED = {"a": pa.int32(), "b": pa.int32(), "chunk": pa.int64(), "plane": pa.int32(), "docs": pa.int64(), "links": pa.int64(), "dense": pa.bool_(), "bits": pa.binary()}
MERGED_DDL = "a int, b int, chunk long, plane int, docs long, links long, dense boolean, bits binary"


def groups_of_batches(batches, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of about GROUP rows, of rows sorted by names, none of which parts rows that are equal in names."""
    rest = None
    for batch in batches:
        for k in range(0, batch.num_rows, GROUP):
            part = batch.slice(k, GROUP)
            if rest is not None:
                part = pa.concat_batches([rest, part])
            keys = [part.column(n).to_numpy() for n in names]
            same = np.logical_and.reduce([x == x[-1] for x in keys])
            end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            rest = part.slice(end)
            if end:
                yield part.slice(0, end)
    if rest is not None and rest.num_rows:
        yield rest


def merge(part: pa.RecordBatch) -> pa.RecordBatch:
    """OR of the bitmaps of each pair, chunk and plane, with counts: documents on a pair's first plane, links on each."""
    a, b, chunk, plane = (part.column(n).to_numpy() for n in ("a", "b", "chunk", "plane"))
    new_pair = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (chunk[1:] != chunk[:-1])])
    new_plane = new_pair | np.concatenate([[True], plane[1:] != plane[:-1]])
    which, numbers = bitmaps.decode(part.column("bits"), part.column("dense").to_numpy(zero_copy_only=False))
    of_plane, of_pair = np.cumsum(new_plane) - 1, np.cumsum(new_pair) - 1
    key = np.unique(of_plane[which] << 16 | numbers)
    begins = np.searchsorted(key >> 16, np.arange(of_plane[-1] + 1))
    popcount = np.diff(np.append(begins, len(key)))
    first = np.flatnonzero(new_plane)
    docs = np.zeros(len(first), np.int64)
    docs[of_plane[new_pair]] = np.bincount(np.unique(of_pair[which] << 16 | numbers) >> 16, minlength=of_pair[-1] + 1)
    bits, dense = bitmaps.encode(key & 0xFFFF, begins)
    return batch_of(MERGED, a=a[first], b=b[first], chunk=chunk[first], plane=plane[first], docs=docs, links=popcount << plane[first].astype(np.int64), dense=dense, bits=bits)


def _merge(batches):
    for part in groups_of_batches(batches, ["a", "b", "chunk"]):
        yield merge(part)


def _scores(batches):
    """Rows sorted by chunk: the sums of its documents, kept for one chunk at a time."""
    schema, at = {"row": pa.int64(), "n_best": pa.int64(), "count_sum": pa.int64()}, None
    sums = np.zeros((2, bitmaps.SPAN), np.int64)

    def done():
        some = np.flatnonzero(sums[1])
        return batch_of(schema, row=(at << 16) + some, n_best=sums[0][some], count_sum=sums[1][some])

    for batch in batches:
        for k in range(0, batch.num_rows, GROUP):
            part = batch.slice(k, GROUP)
            chunk = part.column("chunk").to_numpy()
            which, numbers = bitmaps.decode(part.column("bits"), part.column("dense").to_numpy(zero_copy_only=False))
            value = np.left_shift(1, part.column("plane").to_numpy().astype(np.int64))
            best, total = value * part.column("best").to_numpy(zero_copy_only=False), value * part.column("n").to_numpy()
            for c in np.unique(chunk).tolist():
                if c != at:
                    if at is not None:
                        yield done()
                        sums[:] = 0
                    at = c
                here = chunk[which] == c
                np.add.at(sums[0], numbers[here], best[which[here]])
                np.add.at(sums[1], numbers[here], total[which[here]])
    if at is not None:
        yield done()


def align_tokens(docs: DataFrame, a_path: str, b_path: str, links: int = LINKS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and pairs (a, b, n_docs, n_links, best).

    a_path is a byte-level file of `tokenizers`, b_path a `sentencepiece` model; both are read by the executors. links bounds what a task gathers. A pair's n_docs is the
    number of rows that hold it linked, best whether that is the highest of its a. Special tokens' strings are plain text.
    Null and empty texts, and texts whose joined token bytes differ from a space and the text, have zeros and ''.
    Ids may be null or repeated: one row per row, each its own document. Texts may be of any length; the distinct pairs of one text are
    kept in its task. Other columns aren't read. An empty table gives empty results.
    """
    store = Store(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = store.put(rows.mapInArrow(_scan(a_path, b_path, links), SCAN_DDL), "scan")
    partial = scan.where("row is null").select("a", "b", "chunk", "plane", "dense", "bits").repartition("a", "b", "chunk")
    merged = store.put(partial.sortWithinPartitions("a", "b", "chunk", "plane").mapInArrow(_merge, MERGED_DDL), "merged")
    salt = F.pmod("chunk", F.lit(SALTS)).alias("salt")
    dealt = store.put(merged.groupBy("a", "b", salt).agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")), "counts")
    counts = dealt.groupBy("a", "b").agg(F.sum("docs").alias("n"), F.sum("links").alias("links"))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # at most one row per id of A
    counts = store.put(counts.join(F.broadcast(highest), "a").select("a", "b", "n", "links", (F.col("n") == F.col("highest")).alias("best")), "pairs")
    known = dealt.select("a", "b", "salt").join(counts.select("a", "b", "n", "best"), ["a", "b"])
    back = merged.select("a", "b", salt, "chunk", "plane", "dense", "bits").join(known, ["a", "b", "salt"])
    back = back.select("chunk", "plane", "dense", "bits", "n", F.col("best").cast("long").alias("best")).repartition("chunk").sortWithinPartitions("chunk")
    sums = store.put(back.mapInArrow(_scores, "row long, n_best long, count_sum long"), "sums")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = scan.where("row is not null").join(sums, "row", "left")
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), counts.select("a", "b", F.col("n").alias("n_docs"), F.col("links").alias("n_links"), "best")
