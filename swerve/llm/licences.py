"""Licence scans by ordered signature rules, in DataFrame functions only.

Each rule is a regex with a literal keyword, a label, a priority and a confidence. Texts that hold
a keyword are matched against that keyword's rules. Where detected intervals overlap, one inside
another or not, the best is taken first and puts out those that overlap it, and so on: the rule of the
higher form is better (an identifier before a grant, a grant before a name, a name before a mention), of
equal forms the longer interval, then the earlier rule. What is put out puts out nothing itself. All is done
within the row of a text: nothing is shuffled. Three fixed phrases are counted beside the rules and
always stay.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases, and their words.
PHRASES = (("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved")))
#: Priorities of one form of a rule lie within so many of each other.
FORM = 100_000
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: label, names as regexes, keyword that every name holds (lower case), identifiers
FAMILIES = [
    ("apache-2.0", [r"apache(?: software)? licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?", r"apache[- ]2\.0"], "apache", ["Apache-2.0"]),
    ("apache-1.1", [r"apache software licen[cs]e,? (?:version |v)?1\.1"], "apache", ["Apache-1.1"]),
    ("mit", [r"mit licen[cs]e", r"expat licen[cs]e"], "licen", ["MIT", "MIT-0"]),
    ("bsd-2-clause", [r"(?:simplified|2[- ]clause|freebsd) bsd licen[cs]e", r"bsd 2[- ]clause(?: licen[cs]e)?"], "bsd", ["BSD-2-Clause"]),
    ("bsd-3-clause", [r"(?:new|modified|revised|3[- ]clause) bsd licen[cs]e", r"bsd 3[- ]clause(?: licen[cs]e)?"], "bsd", ["BSD-3-Clause"]),
    ("bsd", [r"bsd(?:[- ]style)? licen[cs]e"], "bsd", ["BSD"]),
    ("isc", [r"isc licen[cs]e"], "isc", ["ISC"]),
    ("gpl-2.0", [r"(?:gnu )?general public licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?", r"gpl ?v?2(?:\.0)?"], "g", ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"]),
    ("gpl-3.0", [r"(?:gnu )?general public licen[cs]e,?(?: version| v\.?)? ?3(?:\.0)?", r"gpl ?v?3(?:\.0)?"], "g", ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"]),
    ("gpl", [r"gnu general public licen[cs]e", r"gnu gpl"], "gnu", ["GPL"]),
    ("lgpl-2.1", [r"(?:gnu )?(?:lesser|library) general public licen[cs]e,?(?: version| v\.?)? ?2\.1", r"lgpl ?v?2\.1"], "l", ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"]),
    ("lgpl-3.0", [r"(?:gnu )?lesser general public licen[cs]e,?(?: version| v\.?)? ?3(?:\.0)?", r"lgpl ?v?3"], "l", ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"]),
    ("lgpl", [r"(?:gnu )?(?:lesser|library) general public licen[cs]e"], "general public", ["LGPL"]),
    ("agpl-3.0", [r"(?:gnu )?affero general public licen[cs]e(?:,?(?: version| v\.?)? ?3(?:\.0)?)?", r"agpl ?v?3"], "a", ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"]),
    ("mpl-2.0", [r"mozilla public licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?"], "mozilla", ["MPL-2.0"]),
    ("mpl-1.1", [r"mozilla public licen[cs]e,?(?: version| v\.?)? ?1\.1"], "mozilla", ["MPL-1.1"]),
    ("mpl", [r"mozilla public licen[cs]e"], "mozilla", ["MPL"]),
    ("epl-2.0", [r"eclipse public licen[cs]e(?:,?(?: -)?(?: version| v\.?)? ?[12]\.0)?"], "eclipse", ["EPL-1.0", "EPL-2.0"]),
    ("cddl-1.0", [r"common development and distribution licen[cs]e"], "common development", ["CDDL-1.0", "CDDL-1.1"]),
    ("cpl-1.0", [r"common public licen[cs]e"], "common public", ["CPL-1.0"]),
    ("eupl-1.2", [r"european union public licen[cs]e"], "european union", ["EUPL-1.1", "EUPL-1.2"]),
    ("artistic-2.0", [r"artistic licen[cs]e(?: 2\.0)?"], "artistic", ["Artistic-1.0", "Artistic-2.0"]),
    ("zlib", [r"zlib(?:/libpng)? licen[cs]e"], "zlib", ["Zlib"]),
    ("boost-1.0", [r"boost software licen[cs]e"], "boost", ["BSL-1.0"]),
    ("unlicense", [r"the unlicen[cs]e"], "unlicen", ["Unlicense"]),
    ("wtfpl", [r"wtfpl"], "wtfpl", ["WTFPL"]),
    ("python-2.0", [r"(?:python software foundation|psf) licen[cs]e"], "licen", ["Python-2.0", "PSF-2.0"]),
    ("postgresql", [r"postgresql licen[cs]e"], "postgresql", ["PostgreSQL"]),
    ("ofl-1.1", [r"(?:sil )?open font licen[cs]e"], "open font", ["OFL-1.1"]),
    ("odbl-1.0", [r"open (?:data commons )?(?:open )?database licen[cs]e"], "database", ["ODbL-1.0"]),
    ("cc0-1.0", [r"cc0(?: 1\.0)?", r"creative commons zero"], "c", ["CC0-1.0"]),
    ("cc-by-sa", [r"creative commons attribution[- ]share ?alike", r"cc[- ]by[- ]sa(?:[- ][1-4]\.[05])?"], "c", ["CC-BY-SA-3.0", "CC-BY-SA-4.0"]),
    ("cc-by-nc", [r"creative commons attribution[- ]non ?commercial", r"cc[- ]by[- ]nc(?:[- ][1-4]\.[05])?"], "c", ["CC-BY-NC-4.0"]),
    ("cc-by-nc-sa", [r"cc[- ]by[- ]nc[- ]sa(?:[- ][1-4]\.[05])?"], "c", ["CC-BY-NC-SA-4.0"]),
    ("cc-by-nd", [r"creative commons attribution[- ]no ?deriv(?:ative)?s?", r"cc[- ]by[- ]nd(?:[- ][1-4]\.[05])?"], "c", ["CC-BY-ND-4.0"]),
    ("cc-by-nc-nd", [r"cc[- ]by[- ]nc[- ]nd(?:[- ][1-4]\.[05])?"], "c", ["CC-BY-NC-ND-4.0"]),
    ("cc-by", [r"creative commons attribution", r"cc[- ]by(?:[- ][1-4]\.[05])?"], "c", ["CC-BY-3.0", "CC-BY-4.0"]),
    ("openrail", [r"(?:creativeml )?open ?rail(?:[- ]?[ms])?(?: licen[cs]e)?"], "rail", ["OpenRAIL"]),
    ("gfdl", [r"(?:gnu )?free documentation licen[cs]e"], "free documentation", ["GFDL-1.2", "GFDL-1.3"]),
    ("ms-pl", [r"microsoft (?:public|reciprocal) licen[cs]e"], "microsoft", ["MS-PL", "MS-RL"]),
    ("sspl-1.0", [r"server side public licen[cs]e"], "server side", ["SSPL-1.0"]),
    ("busl-1.1", [r"business source licen[cs]e"], "business source", ["BUSL-1.1"]),
    ("elastic-2.0", [r"elastic licen[cs]e(?: 2\.0| v2)?"], "elastic", ["Elastic-2.0"]),
]
#: rules about rights that name no licence: label, regex, keyword, priority, confidence
STATEMENTS = [
    ("reserved", r"all rights (?:are )?(?:strictly )?reserved", "rights", 30, 0.8),
    ("copyright", r"copyright(?:\s*(?:\(c\)|©))?\s*(?:19|20)[0-9]{2}(?:\s*[-,]\s*(?:(?:19|20)[0-9]{2}|present))*", "copyright", 20, 0.5),
    ("copyright", r"copr\.(?:\s*(?:\(c\)|©))?\s*(?:19|20)[0-9]{2}(?:\s*[-,]\s*(?:(?:19|20)[0-9]{2}|present))*", "copr.", 20, 0.5),
    ("copyright", r"©\s*(?:19|20)[0-9]{2}", "©", 20, 0.5),
    ("copyright", r"copyright(?:ed)? by [\w.]+", "copyright", 15, 0.4),
    ("public-domain", r"(?:dedicated to|in|into|placed in) the public domain", "public domain", 40, 0.7),
    ("public-domain", r"no rights reserved", "no rights", 45, 0.7),
    ("mit", r"permission is hereby granted, free of charge, to any person", "permission is hereby", 60, 0.95),
    ("isc", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose", "permission to use", 60, 0.95),
    ("bsd", r"redistribution and use in source and binary forms", "redistribution and use", 55, 0.9),
    ("warranty-disclaimer", r"(?:provided|distributed)[^.]{0,40}[\"' ]as is[\"' ]", "as is", 25, 0.4),
    ("warranty-disclaimer", r"without (?:any )?warrant(?:y|ies) of any kind", "warrant", 25, 0.4),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 50, 0.8),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)", "unauthori", 45, 0.6),
    ("proprietary", r"may not be (?:reproduced|redistributed|copied|republished)", "may not be", 45, 0.6),
    ("licensed", r"licen[cs]ed (?:under|to|by)", "licen", 10, 0.3),
    ("terms", r"subject to (?:the )?(?:licen[cs]e|terms)", "subject to", 10, 0.3),
]
#: Keywords that stand in ordinary words, and the beginnings that every match of their rules has one of.
LONGER = {"cc": ("cc-by", "cc by"), "rail": ("openrail", "open rail")}
#: How a licence is named in running text: regex around the name, priority, confidence.
FORMS = [
    (r"(?:released|licen[cs]ed|distributed|available|published|redistributed)(?: and/or modif(?:y|ied))? under (?:the )?(?:terms of )?(?:the )?{}", 90, 0.95),
    (r"subject to (?:the )?(?:terms of )?(?:the )?{}", 80, 0.9),
    (r"see (?:the )?{} for", 75, 0.8),
    (r"{}", 70, 0.7),
]


#: Identifiers with a hyphen and a digit.
HYPHENED = re.compile(r"-.*[0-9]")


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(keyword, name, regex, label, priority, confidence): every family in every form, identifiers, statements.

    A rule is tried on texts that hold its keyword and its name, which is a part of its regex.
    """
    out = [(key, regex, regex, label, priority * 100, sure) for label, regex, key, priority, sure in STATEMENTS]
    for n, (label, names, key, ids) in enumerate(FAMILIES):
        for name in names:
            word = key if len(key) > 1 else ("general public" if "general public" in name else "creative commons" if "creative" in name else name.split("[")[0].split(" ?")[0].split("(?")[0])
            out += [(word, name, form.format(f"(?:{name})"), label, priority * 100 - n, sure) for form, priority, sure in FORMS]
        ids = [i.replace(".", r"\.") for i in sorted(ids, key=len, reverse=True)]
        named = rf"spdx-licen[cs]e-identifier:\s*\(*(?:{'|'.join(ids)})(?![\w.-])"
        out.append(("spdx", named, named, label, 9900 - n, 0.99))
        # the other licences of an expression, and identifiers that are no ordinary words wherever they stand
        joined = rf"(?-i:AND|OR)\s+\(*(?-i:{'|'.join(ids)})(?![\w.-])"
        out.append(("spdx", joined, joined, label, 9800 - n, 0.9))
        for plain in [i for i in ids if HYPHENED.search(i)]:
            named = plain + r"(?:-only|-or-later|\+)?(?![\w-]|\.[0-9])"
            out.append((plain.replace("\\", "").lower(), named, named, label, 6500 - n, 0.7))
    whole = r"(?i)(?<![0-9A-Za-z]){}(?![0-9A-Za-z])"
    return [(k, whole.format(f"(?:{name})"), whole.format(p), label, priority, sure) for k, name, p, label, priority, sure in out]


def places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Places, from 0, where the words of a phrase stand one after another."""
    at = F.transform(words, lambda w, i: F.when(F.lower(w) == phrase[0], i))
    at = F.filter(at, lambda i: i.isNotNull())
    return F.filter(at, lambda i: F.forall(F.sequence(F.lit(1), F.lit(len(phrase) - 1)), lambda d: F.coalesce(F.lower(F.get(words, i + d)) == F.get(F.array(*map(F.lit, phrase)), d), F.lit(False))))


def spans_of(text: Column, pattern: Column) -> Column:
    """(start, end) of each match of a regex, from the pieces between and the matches themselves."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda acc, s: F.struct((acc["at"] + s["gap"] + s["hit"]).alias("at"), F.concat(acc["spans"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["hit"]).alias("end")))).alias("spans"))
    return F.aggregate(sizes, start, step, lambda acc: acc["spans"])


DETECTION = "struct<start:int,end:int,label:string,priority:int,confidence:double>"


def undisputed(spans: Column) -> Column:
    """Spans by start, without those that overlap a better one that stays. Spans that overlap one another, if
    only through others, are one run, which is settled best first; runs are short where the text is long."""
    none = F.array().cast(f"array<{DETECTION}>")
    rank = lambda x: F.struct(F.floor(x["priority"] / FORM), x["end"] - x["start"], x["priority"])
    first = lambda x, y: F.when(rank(x) > rank(y), -1).when(rank(x) < rank(y), 1).otherwise(0)

    def settled(run: Column) -> Column:
        apart = lambda kept, x: F.forall(kept, lambda k: (k["end"] <= x["start"]) | (x["end"] <= k["start"]))
        best = F.aggregate(F.array_sort(run, first), none, lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
        return F.when(F.size(run) < 2, run).otherwise(F.array_sort(best))

    def step(acc: Column, x: Column) -> Column:
        apart = x["start"] >= acc["end"]
        return F.struct(
            F.when(apart, F.concat(acc["kept"], settled(acc["run"]))).otherwise(acc["kept"]).alias("kept"),
            F.when(apart, F.array(x)).otherwise(F.concat(acc["run"], F.array(x))).alias("run"),
            F.greatest(acc["end"], x["end"]).alias("end"),
        )

    start = F.struct(none.alias("kept"), none.alias("run"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["kept"], settled(acc["run"])))


def detections(text: Column, signatures: list[tuple[str, str, str, str, int, float]] | None = None) -> Column:
    """array<start, end, label, priority, confidence> of a text's undisputed detections; empty for null."""
    own = signatures is None
    by: dict[str, dict[str, list]] = {}
    for n, (key, name, regex, label, priority, sure) in enumerate(rules() if own else signatures):
        by.setdefault(key, {}).setdefault(name, []).append(F.struct(F.lit(regex).alias("regex"), F.lit(label).alias("label"), F.lit(priority * 1000 - n).alias("priority"), F.lit(float(sure)).alias("sure")))
    kind = "array<struct<name:string,rules:array<struct<regex:string,label:string,priority:int,sure:double>>>>"
    groups = {k: F.array(*[F.struct(F.lit(name).alias("name"), F.array(*r).alias("rules")) for name, r in g.items()]) for k, g in by.items()}
    low, empty = F.lower(text), F.array().cast(f"array<{DETECTION}>")
    gated = F.flatten(F.array(*[F.when(F.contains(low, F.lit(k)), g).otherwise(F.array().cast(kind)) for k, g in groups.items()]))
    named = F.flatten(F.transform(F.filter(gated, lambda g: F.rlike(text, g["name"])), lambda g: g["rules"]))
    of = lambda r: F.transform(spans_of(text, r["regex"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority"), r["sure"].alias("confidence")))
    found = undisputed(F.flatten(F.transform(F.filter(named, lambda r: F.rlike(text, r["regex"])), of)))
    gate = reduce(Column.__or__, [F.contains(low, F.lit(w)) for k in by for w in (LONGER.get(k, (k,)) if own else (k,))])
    return F.when(gate, found).otherwise(empty)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    score is the chance that at least one detection is right, taking them as independent; 1 where
    a base phrase stands. Null and empty texts: no words, no labels, score 0. Ids may be null or
    repeated. Other columns are not read. Very long texts are looked at whole; the array of a text grows
    with its detections.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select("id", "text", F.lower("text").alias("low"))
    maybe = F.lit(False)
    for _, phrase in PHRASES:
        every = F.lit(True)
        for w in phrase:
            every = every & F.contains("low", F.lit(w))
        maybe = maybe | every
    rows = rows.select("id", detections(F.col("text")).alias("found"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(maybe, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    none = F.array().cast("array<int>")
    rows = rows.select("id", "found", "n_words", *[F.when(F.col("words").isNotNull(), places(F.col("words"), p)).otherwise(none).alias(f"at{k}") for k, (_, p) in enumerate(PHRASES)])
    ats = [f"at{k}" for k in range(len(PHRASES))]
    every = F.flatten(F.array(*ats))
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, (label, _) in zip(ats, PHRASES, strict=True)])))
    rows = rows.select("id", "found", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"))
    labels = F.array_sort(F.array_union("base", F.transform("found", lambda x: x["label"])))
    doubt = F.aggregate("found", F.lit(1.0), lambda p, x: p * (1 - x["confidence"]))
    return rows.select("id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(1 - doubt).alias("score"))
