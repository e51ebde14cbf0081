"""Token counts of a vocabulary without ids.

Merges never cross pre-tokens, so each distinct pre-token of the corpus is cut into pieces once and
its number of pieces joined to the pre-token frequencies of every document. Frequencies are skewed, so
the join has two parts: the commonest pre-tokens with their pieces (HEAD of them, of bounded
length) are broadcast and added up where the text is read; all others go as (row, pre-token,
frequency) to a shuffled join with the pieces of the distinct ones. Which are common is taken from one text
in SHARE, which decides where a pre-token is joined and no result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, batch_of

#: Pre-tokens that are broadcast, their length at most, and the share of the texts that names them.
HEAD, LONGEST, SHARE = 1 << 18, 128, 8
GROUP = 256
#: Distinct pre-tokens of a task counted together.
CHUNK = 1 << 17
#: The pre-token pattern of byte-level vocabularies, for texts whose letters and digits re knows as they do.
PIECES = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: Where re and Unicode's classes differ: numbers that are no decimal digits, and separators that
#: only re takes for white space.
UNUSUAL = frozenset("\x1c\x1d\x1e\x1f") | {c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Nl", "No")}

_state: dict = {}


def piece_counter(path: str) -> dict:
    """The library's parts of a vocabulary file, kept by the worker; plain: its pre-tokens are those of PIECES."""
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        parts = json.loads(tok.to_str())
        own = parts.get("pre_tokenizer") or {}
        plain = parts.get("normalizer") is None and own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space")
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        _state.update(path=path, tok=tok, plain=plain, special=re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None)
    return _state


def pre_tokens(text: str, state: dict) -> tuple[Counter, int]:
    """Pre-token frequencies of a text and how many added tokens stand in it."""
    parts, added, tok = [text], 0, state["tok"]
    if state["special"] and state["special"].search(text):
        parts = state["special"].split(text)
        added = len(parts) - 1
    found: Counter = Counter()
    for part in parts:
        if state["plain"] and UNUSUAL.isdisjoint(part):
            found.update(PIECES.findall(part))
        elif state["plain"]:
            found.update(part[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(part))
        elif part:
            part = tok.normalizer.normalize_str(part) if tok.normalizer else part
            found.update([x for x, _ in tok.pre_tokenizer.pre_tokenize_str(part)] if tok.pre_tokenizer else [part])
    return found, added


def pieces_of(pre: list[str], state: dict) -> list[int]:
    """Pieces of each pre-token, as pre_tokens gives them."""
    tok = state["tok"]
    if state["plain"]:
        return [len(e) for k in range(0, len(pre), 4096) for e in tok.encode_batch_fast(pre[k : k + 4096], add_special_tokens=False)]
    return [len(tok.model.tokenize(x)) for x in pre]


def _frequencies(path: str):
    schema = {"pre": pa.string(), "n": pa.int64()}

    def run(batches):
        state, counts = piece_counter(path), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(pre_tokens(text or "", state)[0])
                if len(counts) > CHUNK:
                    yield batch_of(schema, pre=list(counts), n=list(counts.values()))
                    counts.clear()
        yield batch_of(schema, pre=list(counts), n=list(counts.values()))

    return run


def _pieces(path: str):
    schema = {"pre": pa.string(), "pieces": pa.int64()}

    def run(batches):
        for batch in batches:
            yield batch_of(schema, pre=batch.column("pre"), pieces=pieces_of(batch.column("pre").to_pylist(), piece_counter(path)))

    return run


def _count(path: str, shared):
    """A row of each text (pre null) with the pieces of its common pre-tokens, and its other pre-tokens."""
    schema = {"row": pa.int64(), "id": pa.int64(), "n_bytes": pa.int64(), "pre": pa.string(), "n": pa.int64()}

    def run(batches):
        state, head = piece_counter(path), shared.value
        row = TaskContext.get().partitionId() << 40  # rows and their pre-tokens are written by the same task
        for batch in batches:
            for k in range(0, batch.num_rows, GROUP):
                out: list[tuple] = []
                for i, text in zip(batch.column("id").slice(k, GROUP).to_pylist(), batch.column("text").slice(k, GROUP).to_pylist(), strict=True):
                    freq, n = pre_tokens(text or "", state)
                    for p, c in freq.items():
                        m = head.get(p)
                        if m is None:
                            out.append((row, None, None, p, c))
                        else:
                            n += m * c
                    out.append((row, i, len((text or "").encode("utf-8", "surrogatepass")), None, n))
                    row += 1
                yield batch_of(schema, **dict(zip(schema, map(list, zip(*out, strict=True)), strict=True)))

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    vocabulary is the path, on every executor, of a file of the `tokenizers` library. Null text is the
    empty text: 0 bytes, 0 tokens. Ids may be null or repeated, and rows equal: one row per row. Other
    columns are not read. An empty table gives an empty result.
    """
    store = Store(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0).select("text")
    common = some.mapInArrow(_frequencies(vocabulary), "pre string, n long").where(F.length("pre") <= LONGEST)
    common = common.groupBy("pre").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre").limit(HEAD).select("pre")
    cut = lambda df: df.mapInArrow(_pieces(vocabulary), "pre string, pieces long")
    head = docs.sparkSession.sparkContext.broadcast({r["pre"]: r["pieces"] for r in cut(common).collect()})
    scan = store.put(rows.mapInArrow(_count(vocabulary, head), "row long, id long, n_bytes long, pre string, n long"), "scan")
    rest = scan.where("pre is not null").select("row", "pre", "n")
    pieces = store.put(cut(rest.select("pre").distinct()), "pieces")
    added = rest.join(pieces, "pre").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    counted = scan.where("pre is null").join(added, "row", "left").select("id", "n_bytes", (F.col("n") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
