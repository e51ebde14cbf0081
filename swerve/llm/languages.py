"""Language of a text by compression.

Each language has a raw-content dictionary for zstandard, made of pieces of its labelled texts. A text is
encoded once with each dictionary, and the one with the smallest result names its language; where the second is
nearly as small, the answer is rejected. Dictionaries and texts are letters in lower case with one space between
words: digits, signs and capitals tell little of a language and much of a text's form.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, once

#: Bytes of a language's dictionary, and characters of one of its pieces.
DICTIONARY, PIECE = 128 << 10, 256
#: Bytes and share of the smallest size by which the second must be larger.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.01
#: Bytes of difference that make a language e times less likely.
SOFTNESS = 4.0
UNDETERMINED = "und"
NO_LETTERS, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters_of(text: str | None) -> str:
    """The text's letters in lower case, words parted by one space; '' if it has none."""
    text = text or ""
    return f" {NO_LETTERS.sub(' ', text.lower()).strip()} " if LETTER.search(text) else ""


def _pieces(shares: dict[str, float]):
    schema = {"lang": pa.string(), "hash": pa.int64(), "piece": pa.string()}
    below = {lang: int(share * (1 << 63)) for lang, share in shares.items()}

    def run(batches):
        for batch in batches:
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = letters_of(text)
                for k in range(0, len(text), PIECE):
                    h = xxhash.xxh64_intdigest(text[k : k + PIECE]) >> 1
                    if h < below[lang]:
                        out.append((lang, h, text[k : k + PIECE]))
            lang, hashes, piece = zip(*out, strict=True) if out else ((), (), ())
            yield batch_of(schema, lang=lang, hash=hashes, piece=piece)

    return run


def fit(labelled: DataFrame, size: int = DICTIONARY) -> dict[str, bytes]:
    """A dictionary of at most `size` bytes for each non-null lang of labelled (lang, text).

    All texts are read; a dictionary takes the distinct pieces with the smallest hashes, whatever rows
    they stand in, so copies of one text count once and no order matters. Only pieces below a hash limit, about
    twice what fits, are collected, and the limit is raised for a language whose texts repeat too much.
    """
    labelled = labelled.where("lang is not null and text is not null")
    total = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    shares, made = {lang: min(1.0, 2 * size / n) for lang, n in total.items() if n}, {}
    while shares:
        rows = labelled.where(F.col("lang").isin(sorted(shares))).select("lang", "text")
        found: dict[str, list] = {lang: [] for lang in shares}
        for r in rows.mapInArrow(_pieces(shares), "lang string, hash long, piece string").distinct().collect():
            found[r["lang"]].append((r["hash"], r["piece"]))
        short = {}
        for lang, pieces in found.items():
            data = "".join(p for _, p in sorted(pieces)).encode()
            if len(data) < size and shares[lang] < 1:
                short[lang] = min(1.0, 8 * shares[lang])
            elif data:
                made[lang] = data[:size].decode("utf-8", "ignore").encode()
        shares = short
    return made


class Sizes:
    """Compressed sizes of a text by language, with compressors that are made once."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs, self.coders = sorted(dictionaries), []
        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=20, hash_log=17, chain_log=17, search_log=3, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how))

    def of(self, data: bytes) -> list[int]:
        return [len(c.compress(data)) for c in self.coders]


def judge(sizes: list[int], langs: list[str]) -> tuple[str, float, bool]:
    """Language with the smallest size, ties to the smaller name, how sure, and whether the margin is wide enough."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = sizes[:best] + sizes[best + 1 :]
    margin = min(rest, default=math.inf) - sizes[best]
    sure = 1 / sum(math.exp((sizes[best] - s) / SOFTNESS) for s in sizes)
    return langs[best], sure, margin >= max(MARGIN_BYTES, MARGIN_SHARE * sizes[best])


def _predict(shared):
    schema = {"id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64(), "accepted": pa.bool_()}

    def run(batches):
        sizes = once(shared, Sizes)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                data = letters_of(text).encode() if sizes.langs else b""
                out.append(judge(sizes.of(data), sizes.langs) if data else (UNDETERMINED, 0.0, False))
            lang, score, accepted = zip(*out, strict=True) if out else ((), (), ())
            yield batch_of(schema, id=batch.column("id"), lang_pred=lang, score=score, accepted=accepted)

    return run


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every row.

    lang_pred is 'und' with score 0 for texts that are null or have no letter, or if there is no dictionary. accepted is
    false where the margin to the second language is narrow, and for 'und'. Texts of any length are encoded whole.
    Ids may be null or repeated: one row per row. Other columns aren't read. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared), "id long, lang_pred string, score double, accepted boolean")


def labelled(docs: DataFrame, known: Column, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, text) of the rows that may be learned from; rows for which known is null aren't."""
    return docs.where(F.coalesce(known, F.lit(False))).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
