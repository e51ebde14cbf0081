"""Personal data by candidate gradient boosting.

High-recall generators propose spans per kind, overlapping ones too: disguised writings, and parts
of matches that fail the check of their base pattern. Boosted trees score each candidate by its
format and by the words around it; a threshold per kind, calibrated on held-out candidates,
selects redactions, of which overlapping ones of a kind give way to the best. Spans of the fixed
base patterns are always kept.

There are no labelled spans, so examples are planted: each base span of the data is written again
in its own surroundings in the disguises that the generators look for, and beside numbers that make
its base match fail. What is proposed for exactly that place teaches 1, what else is proposed there
teaches 0, as do matches of the data that fail their check and have no part that passes it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, batch_of

KINDS = ("email", "ip", "card", "phone")
#: Examples in a task of the fit; one in FOLDS is held out.
TASK_EXAMPLES, FOLDS = 50_000, 5
ROUNDS, DEPTH = 20, 4
PRECISION, LEAST = 0.98, 0.5

# The base patterns and their checks.
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# High-recall generators beside the base patterns.
WIDE = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]{1,64}(?:\s?[(\[{]\s?(?:at|@)\s?[)\]}]\s?[\w-]{1,63}(?:(?:\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\s+dot\s+|\.)[a-zA-Z0-9-]{2,24}){1,3}|\s+at\s+[\w-]{1,63}(?:\s+dot\s+[a-zA-Z0-9-]{2,24}){1,3}|\s?@\s?[\w-]{1,63}(?:\s?\.\s?[a-zA-Z0-9-]{2,24}){1,3})", re.I),
    "ip": re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])|(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. |\[dot\])[0-9]{1,3}){3}(?![\w.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:(?:[./_]| - |  )[0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![\w+])(?:00[0-9]{1,3}[ ./-]?)?\(?[0-9]{3}\)?[ ./-]{1,2}[0-9]{3}[ ./-][0-9]{4}(?![0-9])"),
}
GROUP = re.compile(r"[0-9]+")
CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "@"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "pay", "iban", "account"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
}
LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in EMAIL_NAME:
            a -= 1
        m = EMAIL_HOST.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def valid(kind: int, span: str) -> bool:
    """Whether the digits of a span pass the check of its kind; emails have none."""
    d = digits_of(span)
    return (True, True, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[kind]


def parts_of(kind: int, text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Runs of whole groups of digits in a failed card or phone that have a length that their kind allows."""
    least, most = (12, 19) if kind == 2 else (9, 15)
    groups = [m.span() for m in GROUP.finditer(text, a, b)]
    out = []
    for i, (start, _) in enumerate(groups):
        n = 0
        for first, end in groups[i:]:
            n += end - first
            if n > most:
                break
            if n >= least and (start, end) != (a, b):
                out.append((a if kind == 3 and i == 0 else start, end))
        if kind == 3:  # a number begins with its plus
            break
    return out


def proposals(text: str) -> list[tuple[int, int, int, bool, bool]]:
    """(kind, start, end, base, failed): failed candidates match a base pattern but not its check, and no
    part of them passes it."""
    found: dict[tuple[int, int, int], tuple[bool, bool]] = {}
    digits = GROUP.search(text) is not None
    for a, b in emails(text):
        found[0, a, b] = (True, False)
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)) if digits else ():
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == 1:
                ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            else:
                ok = valid(kind, m[0])
            parts = parts_of(kind, text, a, b) if kind > 1 and not ok else []
            if ok or kind != 2 or len(digits_of(m[0])) >= 7:
                found[kind, a, b] = (ok, not ok and not any(valid(kind, text[x:y]) for x, y in parts))
            for x, y in parts:
                found.setdefault((kind, x, y), (False, False))
    taken: dict[int, list[tuple[int, int]]] = {}
    for (kind, a, b), (base, _) in found.items():
        if base:
            taken.setdefault(kind, []).append((a, b))
    for kind, name in enumerate(KINDS):
        if (kind == 0 and "at" not in text and "AT" not in text and "At" not in text and "@" not in text) or (kind and not digits):
            continue
        for m in WIDE[name].finditer(text):
            if not any(a < m.end() and m.start() < b for a, b in taken.get(kind, ())):
                found.setdefault((kind, m.start(), m.end()), (False, False))
    return [(kind, a, b, *flags) for (kind, a, b), flags in sorted(found.items(), key=lambda x: (x[0][1], x[0][0], x[0][2]))]


def disguises(kind: int, span: str, salt: int) -> list[tuple[str, int, int, bool]]:
    """(writing, start and end of the planted span in it, whether it is one) of disguised copies of a base
    span, and of look-alikes that aren't one."""
    d, pick = digits_of(span), lambda *ways: ways[salt % len(ways)]
    other = str(10**15 + salt * 7919 % (9 * 10**15))
    if kind == 0:
        name, host = span.rsplit("@", 1)
        x = pick(f"{name} (at) {host}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} at {host.replace('.', ' dot ')}", f"{name} @ {host}")
        return [(x, 0, len(x), True), (f"{name} at {host.split('.')[0]} dot", 0, 0, False)]
    if kind == 1:
        part = span.split(".")
        x = pick(*(gap.join(part) for gap in ("[.]", "(.)", " . ", "[dot]")))
        six = ":".join(f"{int(p[-3:]) * 257 % 65536:x}" for p in part + part[::-1])
        bad = pick(*(gap.join([*part[:3], str(256 + salt % 700)]) for gap in ("[.]", "(.)", " . ", "[dot]")))
        return [(x, 0, len(x), True), (six, 0, len(six), True), (bad, 0, 0, False)]
    if kind == 2:
        wrong = d[:-1] + str((int(d[-1]) + 1 + salt % 9) % 10)
        x, no = (pick("/", ".", " - ", "  ", "_").join(y[k : k + 4] for k in range(0, 16, 4)) if len(y) == 16 else y for y in (d, wrong))
        beside = (f"{d} {other}", 0, len(d)) if salt % 2 else (f"{other} {d}", 17, 17 + len(d))
        return [(x, 0, len(x), True), (no, 0, 0, False), (*beside, True), (f"{wrong} {other}", 0, 0, False)]
    own, tail = d[-10:], f"{salt % 223 + 1}.{salt % 251}.{salt % 97}.{salt % 199 + 1}"
    x = pick(*(f.format(own[:3], own[3:6], own[6:]) for f in ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "001 {} {} {}"))) if len(own) == 10 else span
    no = pick(f"{own[:3]}-{own[3:6]}-{own[6:]}{other}", f"{own[:2]}.{own[2:4]}.{own[4:]}", f"+{d[:3]} ({own[:2]})")
    return [(x, 0, len(x), True), (f"{span} {tail}", 0, len(span), True), (no, 0, 0, False)]


def planted(text: str, kind: int, a: int, b: int) -> list[tuple[int, float, list[float]]]:
    """(kind, label, features) of what is proposed for disguises of a base span in its surroundings."""
    before, after, out = text[max(0, a - 40) : a].rstrip() + " ", " " + text[b : b + 40].lstrip(), []
    salt = sum(map(ord, text[a:b])) * 31 + a
    for writing, start, end, true in disguises(kind, text[a:b], salt):
        whole, at = before + writing + after, len(before)
        for k, x, y, base, _ in proposals(whole):
            if k == kind and not base and x < at + len(writing) and y > at:
                out.append((k, float(true and (x, y) == (at + start, at + end)), features(whole, k, x, y)))
    return out


def features(text: str, kind: int, a: int, b: int) -> list[float]:
    s, before = text[a:b], text[max(0, a - 40) : a].lower()
    d = digits_of(s)
    parts = [p for p in re.split(r"[^0-9A-Za-z]+", s) if p]
    numbers = [int(p[:6]) for p in parts if p.isdigit()]
    return [
        *(float(kind == k) for k in range(4)),
        float(min(len(s), 80)), float(min(len(d), 30)), float(len(parts)), float(max(map(len, parts), default=0)),
        float(max(numbers, default=-1)), float(len(d) >= 2 and luhn(d)), float(s.startswith("+")), float(s.count(".")), float(s.count("-") + s.count(" ")),
        float("@" in s), float(any(w in before for w in CONTEXT[KINDS[kind]])), float(a > 0 and text[a - 1].isalnum()), float(b < len(text) and text[b].isalnum()),
        float(len(LETTERS.findall(s)) >= 3), float(valid(kind, s)), float(re.search(r"[0-9][ .-]?$", before) is not None), float(max(numbers, default=0) <= 255),
    ]


SCHEMA = "id long, row long, kind int, start long, end long, base boolean, label double, features array<double>"


def _candidates(batches):
    """Proposed spans with label null; examples that teach, with start null."""
    schema = {"id": pa.int64(), "row": pa.int64(), "kind": pa.int32(), "start": pa.int64(), "end": pa.int64(), "base": pa.bool_(), "label": pa.float64(), "features": pa.list_(pa.float64())}
    for batch in batches:
        out = []
        for i, row, text in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for kind, a, b, base, failed in proposals(text) if text else ():
                x = features(text, kind, a, b) if not base else None
                out.append((i, row, kind, a, b, base, None, x))
                if base:
                    out += [(i, row, k, None, n, False, label, f) for n, (k, label, f) in enumerate(planted(text, kind, a, b))]
                elif failed:
                    out.append((i, row, kind, None, a, False, 0.0, x))
        cols = list(zip(*out, strict=True)) or [[]] * 8
        yield batch_of(schema, **dict(zip(schema, map(list, cols), strict=True)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every proposed span of every text, and the examples planted for its base spans (start null);
    `row` tells apart rows with equal ids and different texts."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    return rows.mapInArrow(_candidates, SCHEMA)


def examples(found: DataFrame) -> DataFrame:
    """(kind, label, held, vector) of all examples; held out are those whose place by hash within their kind and label is
    divisible by FOLDS.

    Places are counted within ranges of hashes, after the counts of the ranges before. Rows are dealt and ordered by hash, so
    that the trees don't depend on the session's partitions.
    """
    taught = found.where("label is not null").select("kind", "label", F.xxhash64("id", "row", "end", "features").alias("h"), "id", "end", array_to_vector("features").alias("vector"))
    taught = taught.withColumn("part", F.shiftright("h", 54))  # 1,024 ranges
    before = Window.partitionBy("kind", "label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = taught.groupBy("kind", "label", "part").agg(F.count("*").alias("n"))
    far = counts.select("kind", "label", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("far"))
    near = F.row_number().over(Window.partitionBy("kind", "label", "part").orderBy("h", "id", "end"))
    rows = taught.withColumn("near", near).join(F.broadcast(far), ["kind", "label", "part"])
    rows = rows.select("kind", "label", ((F.col("far") + F.col("near")) % FOLDS == 0).alias("held"), "h", "vector")
    return rows.repartition(found.where("label is not null").count() // TASK_EXAMPLES + 1, "h").sortWithinPartitions("h", "kind", "label").select("kind", "label", "held", "vector")


def fit_selector(found: DataFrame):
    """(model, threshold per kind, measures): trees fitted on all examples, of which one in five is held out.

    A kind's threshold is the smallest score, LEAST at least, from which on precision reaches PRECISION
    among its held-out examples, all of them, counted by score. measures: kind -> (precision, recall, held-out examples) at
    it. Without both labels there is no model and no extra span is selected.
    """
    rows = examples(found).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if rows.where("not held").select("label").distinct().count() < 2:
            return None, {}, {}
        model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=5, cacheNodeIds=False).fit(rows.where("not held"))
        p = vector_to_array("probability")[1]
        scores = model.transform(rows.where("held")).groupBy("kind", p.alias("p")).agg(F.count("*").alias("n"), F.sum("label").alias("y"))
        above = Window.partitionBy("kind").orderBy(F.desc("p"))  # a row a score
        reached = scores.select("kind", "p", F.sum("n").over(above).alias("n"), F.sum("y").over(above).alias("y"), F.sum("n").over(Window.partitionBy("kind")).alias("all"), F.sum("y").over(Window.partitionBy("kind")).alias("true"))
        good = reached.where((F.col("p") >= LEAST) & (F.col("true") > 0) & (F.col("y") >= PRECISION * F.col("n")))
        best = good.groupBy("kind").agg(F.min_by(F.struct("p", "n", "y", "all", "true"), "p").alias("b")).select("kind", "b.*").collect()
    finally:
        rows.unpersist()
    return model, {r["kind"]: r["p"] for r in best}, {r["kind"]: (r["y"] / r["n"], r["y"] / r["true"], r["all"]) for r in best}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, kind, start, end, base, score) of every selected span; row tells texts apart.

    Offsets are code points, the end is exclusive. Base spans have score 1. Of selected spans of a kind
    that overlap, the one with the best score stays, then the longest, then the first. Null or empty
    texts have no spans. Rows with equal id and text give their spans once. A null id keeps its
    spans. An empty table gives none.
    """
    found = Store(docs.sparkSession).put(candidates(docs, id_col, text_col), "candidates")
    model, limits, _ = fit_selector(found)
    found = found.where("start is not null").dropDuplicates(["id", "row", "kind", "start", "end"])
    base = found.where("base").select("id", "row", "kind", "start", "end", "base", F.lit(1.0).alias("score"))
    if model is None or not limits:
        return base
    rest = found.where("not base").withColumn("vector", array_to_vector("features"))
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()], F.lit(1.1))
    rest = model.transform(rest).withColumn("score", vector_to_array("probability")[1]).where(F.col("score") >= limit)
    rest = Store(docs.sparkSession).put(rest.select("id", "row", "kind", "start", "end", "base", "score"), "selected")
    better = rest.union(base).select(F.col("id").alias("i"), F.col("row").alias("r"), F.col("kind").alias("k"), F.col("start").alias("a"), F.col("end").alias("b"), F.col("base").alias("o"), F.col("score").alias("s"))
    over = (F.col("row") == F.col("r")) & (F.col("kind") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("start") < F.col("b")) & (F.col("a") < F.col("end"))
    rank = lambda o, s, a, b: F.struct(F.col(o), F.col(s), F.col(b) - F.col(a), -F.col(a))
    return base.union(rest.join(better, over & (rank("o", "s", "a", "b") > rank("base", "score", "start", "end")), "left_anti"))


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row of docs.

    The first four count base spans, n_spans all. Null and empty texts count nothing. Ids may be null or
    repeated: one row per row. Other columns are not read.
    """
    spans = find_pii(docs, id_col, text_col)
    each = F.struct("start", "kind", "end", "base").alias("s")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    grouped = spans.groupBy("id", "row").agg(F.array_sort(F.collect_list(each)).alias("all"))
    is_base = F.filter("all", lambda s: s["base"])
    of_kind = lambda k: F.filter(is_base, lambda s: s["kind"] == k)
    grouped = grouped.select("id", "row", *[F.size(of_kind(k)).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)], text(is_base).alias("base_spans"), text(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("row"))
    g = grouped.select(F.col("id").alias("gid"), F.col("row").alias("grow"), *[c for c in grouped.columns if c not in ("id", "row")])
    out = rows.join(g, (F.col("row") == F.col("grow")) & F.col("id").eqNullSafe(F.col("gid")), "left")
    counts = [F.coalesce(f"n_{n}", F.lit(0).cast("long")).alias(f"n_{n}") for n in KINDS]
    return out.select("id", *counts, F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"))
