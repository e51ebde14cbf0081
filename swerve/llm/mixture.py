"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed per cell of (source, language, topic). The cell weights are raked until
their marginals are the targets; the ratio of raked to present weight is the factor of a cell.
Documents are kept with calibrated probabilities, by a hash of their id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store

DIMENSIONS = ("source", "lang", "topic")
#: Values of a dimension kept apart; rarer ones share one pooled value, so the cell table is bounded.
VALUES, POOLED, NONE = 200, "(other)", "(null)"
#: Mark of a value of the data, which so is never taken for the pooled or the null one.
OWN = "="
#: Cells whose rates are broadcast at most; more are joined by a shuffle.
BROADCAST_CELLS = 1 << 16
ROUNDS, TOLERANCE = 200, 1e-10
TEMPER, KEEP = 0.5, 0.5


def topic_of(text: Column) -> Column:
    """The form of a text: tabular, loud, marked up, terse or prose (null and empty text: terse)."""
    text = F.coalesce(text, F.lit(""))
    size, share = F.octet_length(text), lambda c: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return (
        F.when(size < 400, "terse")
        .when(share("|") * 40 > size, "tabular")
        .when((share("%") + share("$") + share("#") + share("&")) * 20 > size, "marked")
        .when(F.upper(text) == text, "loud")
        .otherwise("prose")
    )


def n_words(text: Column) -> Column:
    """Runs of anything but white space; 0 for no text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rake_cells(at: list[np.ndarray], w: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Scale cell weights until the marginal over each axis is that axis' target; at has each cell's place by axis.

    Targets are shares of one; a value without any weight can't be reached, so its share goes to
    the others of its axis. Only cells that occur are held.
    """
    w = w / w.sum() if w.sum() > 0 else w.astype(float)
    sums = lambda i, g: np.bincount(i, weights=w, minlength=len(g))
    goal = [np.where(sums(i, t) > 0, t, 0.0) for i, t in zip(at, targets, strict=True)]
    goal = [g / g.sum() if g.sum() > 0 else g for g in goal]
    for _ in range(rounds):
        worst = 0.0
        for i, g in zip(at, goal, strict=True):
            now = sums(i, g)
            worst = max(worst, float(np.abs(now - g).max(initial=0)))
            w = w * np.divide(g, now, out=np.zeros_like(now), where=now > 0)[i]
        if worst < tolerance:
            break
    return w


def rake(cells: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """rake_cells of a whole table of weights."""
    return rake_cells([i.ravel() for i in np.indices(cells.shape)], cells.ravel(), targets, rounds, tolerance).reshape(cells.shape)


def calibrate(present: np.ndarray, wanted: np.ndarray, keep: float) -> np.ndarray:
    """Probabilities of at most 1 that are proportional to wanted / present where below 1 and keep
    the share `keep` of all weight, or as much as there is."""
    share = present / present.sum()
    ratio = np.divide(wanted, share, out=np.zeros_like(share), where=share > 0)
    lo, hi = 0.0, 1.0
    reach = lambda c: float((share * np.minimum(1.0, c * ratio)).sum())
    while reach(hi) < keep - 1e-12 and hi < 1e12:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if reach(mid) < keep else (lo, mid)
    return np.minimum(1.0, hi * ratio)


def mix_sources(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temper: float = TEMPER, topic: Column | None = None, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = 11) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic, mix_weight, mix_probability and mix_sampled.

    targets gives shares by dimension and value; what they leave of one, or the share named
    '(other)', goes to the values without a target, by their present shares; the share named '(null)' is that of null values. A dimension left out
    gets its present shares to the power `temper`. Weights are words unless given; null weight is
    0. Null values are their own value '(null)'; values beyond the VALUES heaviest of a dimension
    are pooled as '(other)' unless they have a target. A document
    is sampled if a hash of its id lies below its probability: rows with equal ids share their
    fate, a null id hashes as the text ''. Columns of docs with these names are replaced. An
    empty table gives an empty result.
    """
    names = [f"mix_{d}" for d in DIMENSIONS]
    docs = docs.drop(*names, "mix_weight", "mix_probability", "mix_sampled")
    text = F.col(text_col)
    values = (F.col(source_col), F.col(lang_col), topic if topic is not None else topic_of(text))
    wide = docs.select("*", *[F.coalesce(F.concat(F.lit(OWN), v.cast("string")), F.lit(NONE)).alias(n) for v, n in zip(values, names, strict=True)], F.coalesce(weight.cast("double") if weight is not None else n_words(text).cast("double"), F.lit(0.0)).alias("mix_weight"))
    cells = Store(docs.sparkSession).put(wide.groupBy(*names).agg(F.sum("mix_weight").alias("w")), "cells")
    coded = {d: {v if v in (POOLED, NONE) else OWN + v: float(t) for v, t in by.items()} for d, by in (targets or {}).items()}
    plain = [F.regexp_replace(n, f"^{OWN}", "").alias(n) for n in names]
    pooled = wide
    for d, n in zip(DIMENSIONS, names, strict=True):
        top = cells.groupBy(n).agg(F.sum("w").alias("w")).orderBy(F.desc("w"), n).limit(VALUES).collect()
        apart = sorted({r[n] for r in top} | set(coded.get(d, {})))
        if apart:
            pooled, cells = (t.withColumn(n, F.when(F.col(n).isin(apart), F.col(n)).otherwise(POOLED)) for t in (pooled, cells))
    table = cells.groupBy(*names).agg(F.sum("w").alias("w")).where("w > 0").toPandas()
    if not len(table):
        return wide.select(*docs.columns, *plain, "mix_weight", F.lit(0.0).alias("mix_probability"), F.lit(False).alias("mix_sampled"))
    levels = [sorted(table[n].unique()) for n in names]
    at = [table[n].map({v: i for i, v in enumerate(x)}).to_numpy() for n, x in zip(names, levels, strict=True)]
    present = table["w"].to_numpy(float)
    goals = []
    for i, d, x in zip(at, DIMENSIONS, levels, strict=True):
        share = np.bincount(i, weights=present, minlength=len(x)) / present.sum()
        if d in coded:
            named = {v: t for v, t in coded[d].items() if v != POOLED}
            goal = np.array([named.get(v, 0.0) for v in x])
            free = np.where([v not in named for v in x], share, 0.0)
            rest = max(0.0, coded[d].get(POOLED, 1 - sum(named.values())))
            goal += rest * free / free.sum() if free.sum() > 0 else 0.0
        else:
            goal = share**temper
        goals.append(goal / goal.sum() if goal.sum() > 0 else share)
    p = calibrate(present, rake_cells(at, present, goals), keep)
    rates = pd.DataFrame({n: np.array(x, object)[i] for n, x, i in zip(names, levels, at, strict=True)} | {"mix_probability": p})
    rates = docs.sparkSession.createDataFrame(rates, ", ".join(f"{n} string" for n in names) + ", mix_probability double")
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = pooled.join(F.broadcast(rates) if len(table) <= BROADCAST_CELLS else rates, names, "left").withColumn("mix_probability", F.coalesce("mix_probability", F.lit(0.0)))
    return out.select(*docs.columns, *plain, "mix_weight", "mix_probability", (chance < F.col("mix_probability")).alias("mix_sampled"))
