"""Linking events to records of the same play."""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def status(n: Column) -> Column:
    return F.when(n == 0, "none").when(n == 1, "single").otherwise("multiple")


def slots(df: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """Each row under the first rule that takes its key; a key taken by a rule is gone for later ones."""
    left, parts = df, []
    for name, rule in rules:
        taken = left.where(rule).withColumn("slot", F.lit(name))
        parts.append(taken)
        left = left.join(taken.select(*keys).distinct(), keys, "left_anti")
    return reduce(DataFrame.unionByName, parts)


def greedy(left: dict, right: dict, edges: list[tuple[float, object, object]]) -> list[tuple[int, int, float]]:
    """Greedy one-to-one matching of the members of kinds: ids by kind on each side, and the score of kinds.

    The same as taking all pairs of members by score, then left, then right. Members of a kind differ
    in nothing but their ids, so each side of a kind is used up from its smallest id.
    """
    a, b = ({k: sorted(v, reverse=True) for k, v in side.items()} for side in (left, right))
    out, levels = [], {}
    for s, x, y in edges:
        levels.setdefault(s, {}).setdefault(x, []).append(y)
    for s in sorted(levels, reverse=True):
        ways = levels[s]
        first = [(a[x][-1], x) for x in ways if a.get(x)]
        heapify(first)
        rights = {x: [(b[y][-1], y) for y in ways[x] if b.get(y)] for _, x in first}
        for heap in rights.values():
            heapify(heap)
        while first:
            x, heap = first[0][1], rights[first[0][1]]
            while heap and (not b[heap[0][1]] or b[heap[0][1]][-1] != heap[0][0]):  # used up or moved on since
                y = heap[0][1]
                heapreplace(heap, (b[y][-1], y)) if b[y] else heappop(heap)
            if not heap:
                heappop(first)
                continue
            y = heap[0][1]
            out.append((a[x].pop(), b[y].pop(), s))
            heapreplace(first, (a[x][-1], x)) if a[x] else heappop(first)
    return out


def one_to_one_of_kinds(items: DataFrame, pairs: DataFrame, by: str) -> DataFrame:
    """(l, r, score) of greedy best-first matching within each group of `by`; the order is score, then l, then r.

    items: by, side ('l' or 'r'), kind, id; pairs: by, lk, rk, score, one row for each pair of kinds that
    may match. A group is one fold, as each match depends on those before it; it holds the ids
    and the pairs of kinds, never the pairs of ids.
    """

    def fold(items: pa.Table, pairs: pa.Table) -> pa.Table:
        sides: dict[str, dict] = {"l": {}, "r": {}}
        for side, kind, at in zip(*(items.column(n).to_pylist() for n in ("side", "kind", "id")), strict=True):
            sides[side].setdefault(kind, []).append(at)
        got = greedy(sides["l"], sides["r"], list(zip(*(pairs.column(n).to_pylist() for n in ("score", "lk", "rk")), strict=True)))
        return pa.table({n: pa.array([g[k] for g in got], t) for k, (n, t) in enumerate((("l", pa.int64()), ("r", pa.int64()), ("score", pa.float64())))})

    items, pairs = items.select(by, "side", "kind", c("id").cast("long").alias("id")), pairs.select(c(by).alias("_by"), "lk", "rk", c("score").cast("double").alias("score"))
    return items.groupBy(by).cogroup(pairs.groupBy("_by")).applyInArrow(fold, "l long, r long, score double")


def name_tokens(name: Column, least: float) -> Column:
    """Characters, numbered by occurrence, of which two names share one if their similarity is at least `least`.

    An edit distance is at least the longer length less the characters in common, so names of similarity
    s share s times the longer length or more, and one of them stands among the first
    len - ceil(s * len) + 1 of each name in any fixed order. Empty names are alike among themselves only.
    """
    chars, size = F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0)), F.length(name)
    numbered = F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string")))
    need = F.ceil(F.lit(least) * size - 1e-9)
    return F.when(size == 0, F.array(F.lit(""))).otherwise(F.slice(F.sort_array(numbered, False), F.lit(1), (size - need + 1).cast("int")))
