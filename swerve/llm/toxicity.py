"""Toxicity after noisy-channel deobfuscation.

Hidden words (leetspeak, spacing, repetition) are read as paths through a lattice: each character
offers the letters it may stand for, symbols may be noise, runs may be shorter words' letters,
gaps between single letters may end a word. A character trigram model of the whole corpus weighs
the paths and Viterbi picks the best, for tokens and spaced runs of any length. Patterns only tell
which tokens look hidden. The restored words are scored by a boosted model of words and word
beginnings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, batch_of, crc_mod, once, sparing

#: Labelled rows that the classifier is fitted on at most; the smallest hashes of their ids are taken.
SAMPLE = 12_000
FEATURES, ROUNDS, MIN_TOXIC = 1500, 300, 4
#: Letters that the character model tells apart, commonest first; all others count as one more letter.
#: So it has at most (ALPHABET + 3) ** 3 trigrams, of which none is left out.
ALPHABET, OTHER = 61, "\x00"
CHUNK = 1 << 17

# What a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "¡": "i", "(": "c"}
EDGE = ".,;:?!\"'()[]{}<>%#&*|/\\…“”«»„-_=~^`"
COST_LEET, COST_DROP, COST_GAP, COST_RUN, COST_BREAK = 0.7, 2.5, 0.2, 0.7, 2.0
WORD = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\S)(?:[^\s\w]?[\w@$!][\s.*_-]){3,}[\w@$!](?![^\s.,;:?!])")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
INNER = re.compile(r"[^\W\d_][^\w\s=/:]{0,2}[0-9@$!|+€][^\W\d_]|(?:[0-9@$!|+€]+[^\W\d_]+){2}|^[0-9@$!|+€]{1,2}[^\W\d_]{2}|[^\W\d_]{2}[0-9@$!|+€]{1,2}$|^[^\W\d_](?:[.*_-]+[^\W\d_]){2}")


class CharModel:
    """Log probability of a character after two others, with add-k smoothing; letters are those of `letters`."""

    def __init__(self, trigrams: list[tuple[str, int]], k: float = 0.05, letters: frozenset[str] | None = None):
        pairs: Counter = Counter()
        self.letters = letters
        for g, n in trigrams:
            pairs[g[:2]] += n
        size = len({g[2] for g, _ in trigrams}) + 1
        self.log = {g: math.log((n + k) / (pairs[g[:2]] + k * size)) for g, n in trigrams}
        self.back = {p: math.log(k / (n + k * size)) for p, n in pairs.items()}
        self.none = -math.log(size + 1) * 1.5

    def __call__(self, two: str, c: str) -> float:
        return self.log.get(two + c) or self.back.get(two, self.none)

    def known(self, c: str) -> str:
        return c if self.letters is None or c in self.letters or c in "^$" else OTHER


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings, with their costs, of each run of equal characters."""
    steps = []
    for c, run in groupby(token.lower()):
        n = len(list(run))
        letters = [(c, 0.0)] if c.isalpha() else [(x, COST_LEET * n) for x in LEET.get(c, "")]
        ways = []
        for x, cost in letters:
            ways.append((x, cost + (COST_RUN if n > 1 else 0.0)))
            if n > 1:
                ways.append((x * 2, cost + (COST_RUN if n > 2 else 0.0)))
        if not c.isalpha() and not c.isdigit():
            ways.append(("", COST_GAP if c in " .-_*\t\n" else COST_DROP))
        elif not letters:
            ways.append(("", COST_DROP * 2))
        steps.append(ways)
    return steps


def restore(token: str, model: CharModel, breaks: bool = False) -> str:
    """The likeliest word behind a token, or words if its gaps may end them (breaks)."""
    states = {"^^": (0.0, "")}
    for ways in lattice(token):
        ended = {}
        if breaks and any(not add for add, _ in ways):
            score, text = max((s + model(two, "$") - COST_BREAK, t + " ") for two, (s, t) in states.items())
            ended = {"^^": (score, text)} if text.strip() else {}
        new: dict[str, tuple[float, str]] = {}
        for two, (score, text) in states.items():
            for add, cost in ways:
                s, at = score - cost, two
                for c in map(model.known, add):
                    s += model(at, c)
                    at = at[1] + c
                if at not in new or s > new[at][0]:
                    new[at] = (s, text + add)
        for at, (s, text) in ended.items():
            if at not in new or s > new[at][0]:
                new[at] = (s, text)
        states = new
    return max((s + model(two, "$"), t) for two, (s, t) in states.items())[1]


def words_in(token: str, model: CharModel | None) -> tuple[str, ...]:
    """The words of one token without white space, with the restored one if it looks hidden."""
    core = token.strip(EDGE).lower()
    if core.isalpha() and not TRIPLE.search(core):
        return (core,)
    words = (core,) if core.isalpha() else tuple(WORD.findall(core))
    if not model or len(core) < 3 or ("@" in core and core.rfind(".") > core.find("@")):
        return words
    return (*words, restore(core, model)) if TRIPLE.search(core) or INNER.search(core) else words


def spaced_words(text: str, model: CharModel | None) -> list[str]:
    """Words written with gaps between their letters, read as one word and as several."""
    return [w for m in SPACED.findall(text) for w in (restore(m.strip(), model), *restore(m.strip(), model, True).split())] if model else []


class Memory(dict):
    """What was found out about tokens, forgotten as a whole when it grows too large."""

    def __init__(self, of, size: int = 100_000):
        self.of, self.size = of, size

    def __missing__(self, token):
        if len(self) >= self.size:
            self.clear()
        self[token] = found = self.of(token)
        return found


def features_of(words: set[str]) -> set[str]:
    """Words, and beginnings of four and five letters marked by *."""
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


@sparing
def _count_words(batches):
    schema, counts = {"w": pa.string(), "n": pa.int64()}, Counter()

    def out():
        words: Counter = Counter()
        for token, n in counts.items():
            for w in words_in(token, None):
                words[w] += n
        counts.clear()
        return batch_of(schema, w=list(words), n=list(words.values()))

    for batch in batches:
        for t in batch.column("text").to_pylist():
            counts.update(t.split() if t else ())
            if len(counts) > CHUNK:
                yield out()
    yield out()


@sparing
def _trigrams(batches):
    counts: Counter = Counter()
    for batch in batches:
        for w, n in zip(batch.column("w").to_pylist(), batch.column("n").to_pylist(), strict=True):
            w = f"^^{w}$"
            for i in range(len(w) - 2):
                counts[w[i : i + 3]] += n
            if len(counts) > CHUNK:
                yield batch_of({"g": pa.string(), "n": pa.int64()}, g=list(counts), n=list(counts.values()))
                counts.clear()
    yield batch_of({"g": pa.string(), "n": pa.int64()}, g=list(counts), n=list(counts.values()))


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Character trigrams of the words of every text, weighted by how often each word occurs."""
    words = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_words, "w string, n long")
    grams = words.groupBy("w").agg(F.sum("n").alias("n")).mapInArrow(_trigrams, "g string, n long")
    grams = Store(docs.sparkSession).put(grams.groupBy("g").agg(F.sum("n").alias("n")), "trigrams")
    last = grams.groupBy(F.substring("g", 3, 1).alias("c")).agg(F.sum("n").alias("n")).where("c != '$'")
    letters = [r["c"] for r in last.orderBy(F.desc("n"), "c").limit(ALPHABET).collect()]
    known = lambda k: F.when(F.substring("g", k, 1).isin([*letters, "^", "$"]), F.substring("g", k, 1)).otherwise(OTHER)
    bounded = grams.groupBy(F.concat(known(1), known(2), known(3)).alias("g")).agg(F.sum("n").alias("n"))
    return CharModel(sorted((r["g"], r["n"]) for r in bounded.collect()), letters=frozenset(letters))


def _featurise(shared):
    schema = {"toxic": pa.int32(), "features": pa.list_(pa.string())}

    @sparing
    def run(batches):
        model = shared.value
        memory = once(shared, lambda model: Memory(lambda token: words_in(token, model)))
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                words = {w for token in set((t or "").split()) for w in memory[token]}
                rows.append(sorted(features_of(words | set(spaced_words(t or "", model)))))
            yield batch_of(schema, toxic=batch.column("toxic"), features=rows)

    return run


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, ridge: float = 0.25) -> tuple[float, np.ndarray]:
    """Logistic boosting: each round adds a Newton step for the feature that gains most, then one for the bias."""
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    bias, w = math.log(rate / (1 - rate)), np.zeros(x.shape[1])
    margin = np.full(len(y), bias)
    for _ in range(rounds if x.shape[1] else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = (y - p) @ x, (p * (1 - p)) @ x + ridge
        gain = np.where(g > 0, g * g / h, 0)  # only what speaks for toxicity is a feature
        j = int(np.argmax(gain))
        if gain[j] < 0.5:
            break
        w[j] += (step := min(g[j] / h[j], 4.0))
        margin += step * x[:, j]
        p = 1 / (1 + np.exp(-margin))
        shift = max(-0.5, min(0.5, (y - p).sum() / ((p * (1 - p)).sum() + ridge)), -6.0 - bias)
        bias += shift
        margin += shift
    return bias, w


class ToxicityModel:
    def __init__(self, chars: CharModel, bias: float, weights: dict[str, float]):
        self.chars, self.bias, self.weights = chars, bias, weights

    def told(self, words) -> tuple[str, ...]:
        """The model's features among those of some words."""
        return tuple(features_of(set(words)) & self.weights.keys())

    def memory(self) -> Memory:
        return Memory(lambda token: self.told(words_in(token, self.chars)))

    def score(self, text: str, memory: Memory) -> float:
        found: set[str] = set()
        for token in set(text.split()):
            if hit := memory[token]:
                found.update(hit)
        found.update(self.told(spaced_words(text, self.chars)))
        total = self.bias + sum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Character model of all texts; classifier on at most `sample` labelled rows with crc32(id) mod 5 not 0."""
    spark, store = docs.sparkSession, Store(docs.sparkSession)
    chars = char_model(docs, text_col)
    taught = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 5) != 0))
    taught = taught.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    taught = taught.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(taught), "id")
    texts = texts.groupBy("id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))  # an id is one row, however often it stands there
    rows = store.put(texts.select("toxic", "text").mapInArrow(_featurise(spark.sparkContext.broadcast(chars)), "toxic int, features array<string>"), "features")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    seen = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where(F.col("t") >= MIN_TOXIC)
    lift = (F.col("t") / F.lit(max(toxic, 1))) / ((F.col("n") - F.col("t") + 0.5) / F.lit(max(n - toxic, 1)))
    best = seen.where(lift >= 3).orderBy(F.desc(F.col("t") * F.log(lift)), "f").limit(FEATURES).select("f").collect()
    names = [r["f"] for r in best]
    at = {f: k for k, f in enumerate(names)}
    found = rows.select("toxic", F.array_intersect("features", F.lit(names) if names else F.array().cast("array<string>")).alias("f")).collect()
    x, y = np.zeros((len(found), len(names)), np.float32), np.array([r["toxic"] for r in found], float)
    for k, r in enumerate(found):
        x[k, [at[f] for f in r["f"]]] = 1
    bias, w = boost(x, y) if len(y) and y.any() else (-5.0, np.zeros(len(names)))
    return ToxicityModel(chars, bias, {f: float(v) for f, v in zip(names, w, strict=True) if v})


def _score(columns: list[str], text_col: str, shared):
    @sparing
    def run(batches):
        model = shared.value
        memory = once(shared, ToxicityModel.memory)
        for batch in batches:
            s = [model.score(t or "", memory) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(s, pa.float64())], names=[*columns, "toxicity"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with a column toxicity, 0 to 1, from the whole text alone.

    Null, empty and wordless texts get the base rate. A column of docs named toxicity is
    replaced; the others are carried along. Equal texts get equal scores.
    """
    docs = docs.drop("toxicity")
    out = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])
    return docs.mapInArrow(_score(docs.columns, text_col, docs.sparkSession.sparkContext.broadcast(model)), out)
