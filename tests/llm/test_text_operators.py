import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from swerve.llm import decontaminate, html, jaccard, licences, lines, mixture, pii, queries, tokens, topk, toxicity
from swerve.llm.mph import PerfectHash
from tests.compare import connect, rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, toxicity string"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0, "x", "y") for k, t in enumerate(texts)], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "One two THREE four", prose(1, 60), prose(1, 60), prose(2, 20000), "naïve ½ ² \x1c <|endoftext|> don't  stop"]


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_against_sql(spark, key):
    assert rows(queries.QUERIES[key](spark, SF).toPandas()) == rows(connect(SF).sql(queries.ORACLES[key]).df())


def brute_components(texts):
    def shingles(t):
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return [(k, len(s), g) for k, (s, g) in enumerate(zip(sets, group))]


def test_jaccard_against_brute_force(spark):
    r, texts = random.Random(5), list(ODD)
    base = prose(9, 120).split()
    for k in range(40):  # a large group of near copies, some linked only through others
        w = list(base)
        for _ in range(k % 5):
            w[r.randrange(len(w))] = f"edit{r.randrange(9)}"
        texts.append(" ".join(w))
    shared = prose(10, 40)
    texts += [f"{prose(100 + k, 30)} {shared}" for k in range(20)]
    got = jaccard.jaccard_components(docs(spark, texts)).orderBy("id").collect()
    assert [tuple(x) for x in got] == brute_components(texts)


def near_copies(seed, n, n_words=60, edits=6):
    """Copies of one text that differ in up to `edits` words, so that their links make chains, groups and loners."""
    r, base = random.Random(seed), prose(seed, n_words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        out.append(" ".join(w[: r.choice((n_words, n_words, n_words - 8))]))
    return out


@pytest.mark.parametrize("rounds, block, rows_", [(1, 16, 64), (3, 256, 4096)])
def test_jaccard_long_lists(spark, monkeypatch, rounds, block, rows_):
    """Long lists with many components, with blocks at once and after more leaders."""
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", rounds), monkeypatch.setattr(jaccard, "BLOCK", block), monkeypatch.setattr(jaccard, "OPEN", 0), monkeypatch.setattr(jaccard, "MARK_ROWS", rows_)
    texts = near_copies(21, 150) + near_copies(22, 60, 12, 3)
    got = jaccard.jaccard_components(docs(spark, texts)).orderBy("id").collect()
    assert [tuple(x) for x in got] == brute_components(texts)


def test_jaccard_ids(spark):
    """Null ids stay with the component of their shingles, repeated ids give a row each, an empty table none."""
    a, b = prose(31, 60), prose(32, 60)
    rows_ = [(5, a), (None, a), (None, b), (7, prose(33, 60)), (7, prose(34, 60)), (9, None), (None, "")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert sorted(map(repr, ((x["id"], x["n_shingles"], x["component_id"]) for x in got))) == sorted(map(repr, [(5, 56, 5), (None, 56, 5), (None, 56, None), (7, 56, 7), (7, 56, 7), (9, 0, 9), (None, 0, None)]))
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_divide_skip_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(60):
        sets = [np.unique(r.integers(0, 60, r.integers(1, 40))).astype(np.uint64) for _ in range(30)]
        query = np.unique(r.integers(0, 60, 30)).astype(np.uint64)
        need, open_ = r.integers(1, 20, 30), r.random(30) < 0.8
        want = [k for k, s in enumerate(sets) if open_[k] and len(np.intersect1d(s, query)) >= need[k]]
        assert jaccard.Lists(sets).search(query, need, open_).tolist() == want


def test_jaccard_of_no_rows(spark):
    assert jaccard.jaccard_components(docs(spark, []).where("false")).count() == 0


def brute_lines(texts, least):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    n = {}
    for s in split:
        for k in {key(x) for x in s}:
            n[k] = n.get(k, 0) + 1
    kept = [[x for x in s if not key(x) or n[key(x)] < least] for s in split]
    return [("\n".join(k), len(s), len(s) - len(k)) for s, k in zip(split, kept)]


@pytest.mark.parametrize("room", [64 << 20, 0])
def test_line_dedup_both_ways(spark, room):
    texts = ODD + [f"Menu \n{prose(k, 5)}\n MENU\n\n{'Footer' if k % 2 else 'other'}" for k in range(8)]
    out = lines.dedup_lines(docs(spark, texts), min_docs=3, broadcast_bytes=room).orderBy("doc_id").collect()
    assert [(x["text"], x["n_lines"], x["n_dropped"]) for x in out] == brute_lines(texts, 3)
    assert [x["source"] for x in out] == ["s"] * len(texts)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(1, 1 << 62, 5000).astype(np.uint64))
    h = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    tok = Tokenizer.from_file(path)
    texts = ODD + ["它是 １２３ Ⅷ a b", "'s 'll IT'S  \n\n x", "<|endoftext|><|endoftext|>"]
    out = tokens.token_counts(docs(spark, texts), path).orderBy("id").collect()
    assert [x["n_tokens"] for x in out] == [len(tok.encode(t or "", add_special_tokens=False)) for t in texts]
    assert [x["n_bytes"] for x in out] == [len((t or "").encode()) for t in texts]


def test_token_counts_of_common_and_rare_pre_tokens(spark, monkeypatch):
    """Any split between the broadcast and the shuffled join gives the library's counts, for other vocabularies too."""
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    texts = [prose(k % 7, 30) + " \u00bd <|endoftext|> don't" for k in range(60)] + ["x" * 500, None, ""]
    d = docs(spark, texts)
    d = d.union(d.where("doc_id = 3")).union(d.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    own = {"model": {"type": "WordLevel", "vocab": {"a": 0, "b": 1, "[U]": 2}, "unk_token": "[U]"}, "pre_tokenizer": {"type": "Whitespace"}, "normalizer": {"type": "Lowercase"}}
    import json
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json", dir="/tmp") as f:
        json.dump({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "post_processor": None, "decoder": None, **own}, f)
        f.flush()
        for where, head in ((path, 1 << 17), (path, 20), (f.name, 5)):
            monkeypatch.setattr(tokens, "HEAD", head), monkeypatch.setattr(tokens, "SHARE", 2)
            tok = Tokenizer.from_file(where)
            n = [len(tok.encode(t or "", add_special_tokens=False)) for t in texts]
            want = sorted(map(repr, [*enumerate(n), (3, n[3]), (None, n[3])]))
            assert sorted(map(repr, ((x["id"], x["n_tokens"]) for x in tokens.token_counts(d, where).collect()))) == want
    assert tokens.token_counts(d.where("false"), path).count() == 0


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(4)
    v = r.normal(0, 0.3, (300, 8))
    v[50:150] = v[0]  # many equal scores
    data = [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(v)] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (None, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = [tuple(x) for x in topk.topk_by_histogram(df, df.where("vec_id % 20 = 0"), k=5, group=6).orderBy("query_id", "rank").collect()]
    q = np.floor(64 * np.array([d[1] for d in data[:300]])).astype(int)
    want = []
    for i in range(0, 300, 20):
        s = q @ q[i]
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate(best)]
    assert got == want
    assert topk.topk_by_histogram(df.where("false"), df.where("false")).count() == 0


def test_html(spark):
    page = "<html><head><title>no</title><style>p{}</style></head><body><nav><a href='/'>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head</h1><p>One &amp; <b>two<p>three\n four<script>var t='</p>'</script></article><div id=comments>Nice</div><footer>&copy;</footer>"
    bare = "<div><a href=a>Home</a></div><div><p>A long first paragraph of text.</p><p>Short.</p></div><form>Search</form>"
    df = spark.createDataFrame([(0, "u", page), (1, None, bare), (2, "u", None), (3, "u", ""), (None, "u", "<p>x")], "page_id long, url string, html string")
    out = {x["page_id"]: (x["text"], x["n_chars"]) for x in html.extract_main_text(df).collect()}
    assert out[0] == ("Head One & two three four", 25)
    assert out[1][0] == "A long first paragraph of text. Short."
    assert out[2] == out[3] == ("", 0) and out[None] == ("x", 1)


def brute_pii(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base_spans(spark):
    texts = ODD + ["é a.b@c.d-e.org, x@y 1.2.3.4 300.1.1.1 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (555) 010-9999 or +12, a@b.c@d.e"]
    texts += [f"ip 10.0.0.{k} mail u{k}@h{k}.net +44 20 7946 0{k:03d} no 4111 1111 1111 11{k:02d} 999.1.1.{k}" for k in range(60)]
    d = docs(spark, texts)
    out = pii.pii_digest(d.union(d.where("doc_id = 9"))).orderBy("id").collect()
    texts.insert(9, texts[9])
    assert [x["base_sha256"] for x in out] == [hashlib.sha256(brute_pii(t).encode()).hexdigest() for t in texts]
    assert all(set(filter(None, brute_pii(t).split(","))) <= set(x["spans"].split(",")) for x, t in zip(out, texts))


def test_licences(spark):
    texts = ODD + ["CC-BY 4.0, cc by; All rights\nreserved.", "Licensed under the Apache License, Version 2.0 (the", "SPDX-License-Identifier: MIT", "the GNU General Public License version 3 or", "summit licence plates"]
    out = {x["id"]: x for x in licences.scan_licences(docs(spark, texts)).collect()}
    n = len(ODD)
    assert (out[n]["base_labels"], out[n]["n_base"], out[n]["first_word"], out[n]["last_word"]) == ("cc-by,reserved", 3, 0, 6)
    assert out[n + 1]["labels"] == "apache-2.0" and out[n + 2]["labels"] == "mit" and out[n + 3]["labels"] == "gpl,gpl-3.0" and out[n + 4]["labels"] == ""
    assert out[0]["n_words"] == 0 and out[0]["first_word"] is None and 0 <= out[n]["score"] <= 1
    assert len({r[2] for r in licences.rules()}) > 200


def test_decontamination_against_brute_force(spark):
    items = [(k, prose(500 + k, 12 + 3 * k)) for k in range(6)] + [(6, "Two words"), (7, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = list(ODD)
    for k in range(6):
        w = items[k][1].split()
        near = w[:-1] + ["changed"] if k % 2 else w
        texts += [f"{prose(700 + k, 50)} {' '.join(near).upper()} {prose(800 + k, 50)}", f"{prose(900 + k, 30)} {' '.join(w[: len(w) // 2])}"]
    texts.append("here are two WORDS")
    got = [sorted(x["items"]) for x in decontaminate.decontaminate(docs(spark, texts), bench, items_at_once=3).orderBy("id").collect()]
    want = []
    for t in texts:
        words, hit = (t or "").lower().split(), []
        for k, item in items:
            w = (item or "").lower().split()
            s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or [tuple(w)]
            for i in range(max(0, len(words) - len(w)) + 1) if w else ():
                v = words[i : i + len(w)]
                z = [tuple(v[j : j + 5]) for j in range(len(v) - 4)] or [tuple(v)]
                low = sum(min(s.count(x), z.count(x)) for x in set(s))
                if v and low / (len(s) + len(z) - low) >= 0.75:
                    hit.append(k)
                    break
        want.append(hit)
    assert got == want


def test_deobfuscation_and_held_out_accuracy(spark):
    model = toxicity.CharModel([(g, 50) for w in ("idiot", "moron", "the", "and") for g in [f"^^{w}$"[i : i + 3] for i in range(len(w) + 1)]])
    assert [toxicity.restore(x, model) for x in ("1d10t", "m0r0n", "i d i o t", "iiidiot", "m.o.r.o.n")] == ["idiot", "moron", "idiot", "idiot", "moron"]
    texts = [prose(k, 40) + (" you moron " if k % 4 == 0 else " ") + prose(k + 1000, 10) for k in range(200)] + [None, "", prose(3, 30) + " m0r0n"]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, texts)
    out = toxicity.score_toxicity(d, toxicity.fit(d, labels)).orderBy("doc_id").collect()
    assert [x["toxicity"] >= 0.5 for x in out[:200]] == [k % 4 == 0 for k in range(200)]
    assert out[200]["toxicity"] == out[201]["toxicity"] < 0.5 <= out[202]["toxicity"]


def test_raking_and_sampling(spark):
    w = mixture.rake(np.random.default_rng(1).uniform(1, 9, (3, 2, 2)), [np.array([0.5, 0.3, 0.2]), np.array([0.7, 0.3]), np.array([0.6, 0.4])])
    assert np.allclose(w.sum(axis=(1, 2)), [0.5, 0.3, 0.2]) and np.allclose(w.sum(axis=(0, 1)), [0.6, 0.4])
    data = [(k, "w " * 99 + "w", "en" if k % 5 else "de", f"s{k % 3}" if k % 7 else None) for k in range(3000)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    out = mixture.mix_sources(d, {"lang": {"en": 0.5, "de": 0.5}}, keep=0.3).where("mix_sampled").groupBy("lang").count().collect()
    n = {x["lang"]: x["count"] for x in out}
    assert abs(n["de"] / (n["de"] + n["en"]) - 0.5) < 0.05 and abs(sum(n.values()) / 3000 - 0.3) < 0.04
    assert mixture.mix_sources(d.where("false")).count() == 0
    assert mixture.mix_sources(docs(spark, ODD)).count() == len(ODD)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    start = d = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = []
    for k, (_, stage) in enumerate(p.STAGES):
        d = stage(spark, d, SF)
        d = spark.createDataFrame(d.collect(), d.schema)
        kept.append(d.count())
        if k < 4:
            assert d.columns == start.columns
    assert start.count() >= kept[0] and kept[0] == kept[1] >= kept[2] >= kept[3] >= kept[4] > 0
    assert p.run(spark, SF).count() == kept[4]
    assert d.where(F.col("mix_probability") <= 0).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    """Repeated rows, rows without id, near copies and benchmark passages, through the stages that decide exactly."""
    import corpus_pipeline as p

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    base, item = prose(51, 100), spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first()["text"]
    texts = [(5, base), (3, base.replace(base.split()[50], "edited")), (3, base.replace(base.split()[50], "edited")), (None, base), (None, prose(52, 50)), (None, prose(52, 50)), (7, prose(53, 60) + " " + item), (None, item), (8, ""), (9, None)]
    texts += [(100 + k, f"{prose(200 + k, 30)}\nSame line in all\n{prose(300 + k, 30)}") for k in range(12)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], columns)
    rows_ = lambda df: sorted(map(repr, ((x["doc_id"], x["text"]) for x in df.collect())))
    cut = p.cut_lines(spark, d, SF)
    kept, _ = zip(*[(k, n) for k, _, n in brute_lines([t for _, t in texts], 10)])
    assert rows_(cut) == sorted(map(repr, ((i, k) for (i, _), k in zip(texts, kept))))
    one = p.keep_one_of_group(spark, cut, SF)
    want = [(i, k) for (i, _), k in zip(texts, kept) if i not in (3, 5, None)] + [(3, texts[1][1]), (None, texts[4][1]), (None, item)]
    assert rows_(one) == sorted(map(repr, want))
    clean = p.drop_contaminated(spark, one, SF)
    assert rows_(clean) == sorted(map(repr, [x for x in want if item not in (x[1] or "")]))
    for _, stage in p.STAGES[1:]:
        assert stage(spark, d.where("false"), SF).count() == 0


def test_licence_names_beside_other_scripts(spark):
    texts = ["\u201cMIT License\u201d", "x\u2014Apache License 2.0\u2014y", "\u672c\u4ef6\u306fMIT License\u3067\u3059", "GPLv3\uff0c\u8bb8\u53ef", "\u00a0BSD license\u00a0", "Copyright2020", "under Open Rails terms", "\u540cCC-BY-SA\u540c", "trail access summits"]
    out = {x["id"]: x["labels"] for x in licences.scan_licences(docs(spark, texts)).collect()}
    assert [out[k] for k in range(9)] == ["mit", "apache-2.0", "mit", "gpl-3.0", "bsd", "copyright", "openrail", "cc-by-sa", ""]


def test_licence_gate_loses_no_match(spark):
    own = licences.rules()
    texts = ["\u201c" + w + "\u201d" for w in ("MIT License", "see the wtfpl for", "subject to the terms", "copr. 1999", "\u00a9 2001", "cc0", "may not be copied", "open rail-m", "creative commons zero", "confidential and proprietary")]
    d = docs(spark, texts + ["nothing of it"])
    found = d.select("doc_id", licences.detections(F.col("text")).alias("a"), licences.detections(F.col("text"), own).alias("b")).orderBy("doc_id").collect()
    assert all(x["a"] == x["b"] for x in found) and [len(x["a"]) > 0 for x in found] == [True] * len(texts) + [False]


def test_licence_overlaps(spark):
    """Overlapping intervals: the higher form stays, of equal ones the longer; apart ones all stay."""
    texts = ["GNU Lesser General Public License version 2.1", "SPDX-License-Identifier: MIT License", "licensed under the Apache License 2.0 and the MIT License", "creative commons attribution-sharealike", None, ""]
    signatures = [("ab", "ab", "abcd", "weak", 1, 0.5), ("bc", "bc", "bc", "strong", 300, 0.5), ("cd", "cd", "cdef", "long", 1, 0.5)]
    out = docs(spark, [*texts, "abcdef", "abcd x cdef"]).select("doc_id", licences.detections(F.col("text")).alias("a"), licences.detections(F.col("text"), signatures).alias("b")).orderBy("doc_id").collect()
    assert [[s["label"] for s in x["a"]] for x in out[:6]] == [["lgpl-2.1"], ["mit"], ["apache-2.0", "mit"], ["cc-by-sa"], [], []]
    assert [[(s["start"], s["end"], s["label"]) for s in x["b"]] for x in out[6:]] == [[(1, 3, "strong")], [(1, 3, "strong"), (7, 11, "long")]]


def test_licence_base_against_brute_force(spark):
    r, words = random.Random(3), ["cc", "CC", "by", "all", "Rights", "reserved", "general", "PUBLIC", "license", "x\u00e9", "9", "\u4e2d"]
    texts = ODD + ["".join(r.choice(words) + r.choice(" -.,\n_/") for _ in range(60)) for _ in range(40)]
    d = docs(spark, texts)
    out = licences.scan_licences(d.union(d.where("doc_id = 12")).union(d.where("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long"))))
    out = {(x["id"], x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) for x in out.collect()}
    want = set()
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for label, p in licences.PHRASES for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        row = (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))
        want |= {(k, *row)} | ({(None, *row)} if k == 12 else set())
    assert out == want and licences.scan_licences(d.where("false")).count() == 0


def test_decontamination_of_documents_shorter_than_the_item(spark):
    w = prose(41, 104).split()
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    texts = [" ".join(w[:84]), " ".join(w[10:92]), " ".join(w[:70])]
    out = decontaminate.decontaminate(docs(spark, texts), bench).orderBy("id").collect()
    assert [(x["items"], x["similarities"]) for x in out] == [([1], [0.8]), ([1], [0.78]), ([], [])]


def test_topic_is_of_the_whole_text(spark):
    texts = ["LOUD WORDS " * 60, "LOUD WORDS " * 60 + "and then not"]
    assert [x[0] for x in docs(spark, texts).orderBy("doc_id").select(mixture.topic_of(F.col("text"))).collect()] == ["loud", "prose"]


def test_targets_of_rare_values(spark):
    data = [(k, "w " * (99 if k % 250 < 210 else 9) + "w", "en", f"s{k % 250}") for k in range(5000)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    p = lambda t: {x["source"]: (x["mix_source"], x["mix_probability"]) for x in mixture.mix_sources(d, {"source": t}, keep=0.0001).collect()}
    named = p({"s240": 0.5, "s0": 0.5})  # s240 is beyond the 200 heaviest
    assert named["s240"][0] == "s240" and abs(named["s240"][1] * 10 / (named["s0"][1] * 100) - 1) < 1e-6 and named["s241"] == ("(other)", 0.0)
    rest = p({"s0": 0.5})  # the other half is for the values that have no target
    assert rest["s240"][0] == "(other)" and 0 < rest["s240"][1] and abs(rest["s240"][1] / rest["s1"][1] - 1) < 1e-6
    assert abs(rest["s0"][1] * 100 - sum(rest[f"s{k}"][1] * (100 if k < 210 else 10) for k in range(1, 250))) < 1e-6 * rest["s0"][1] * 100


def test_decontamination_rows_over_rounds(spark):
    """One row stays one row with repeated and null ids, and items of equal short texts are all named."""
    bench = spark.createDataFrame([(k, prose(600 + k, 30)) for k in range(6)] + [(8, "two words"), (9, "Two Words"), (None, prose(1, 60))], "item_id long, text string")
    data = [(1, prose(600, 30)), (1, prose(603, 30)), (None, prose(604, 30)), (None, "just two words"), (1, prose(600, 30)), (2, None)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted(map(repr, [(1, [0]), (1, [3]), (None, [4]), (None, [8, 9]), (1, [0]), (2, [])]))
    for at_once in (20_000, 3):
        assert sorted(map(repr, ((x["id"], x["items"]) for x in decontaminate.decontaminate(d, bench, items_at_once=at_once).collect()))) == want
    clash = d.withColumn("items", F.lit("x")).withColumn("Found_by_text", F.lit("y")).withColumn("text_key", F.lit("z"))
    out = decontaminate.matched(clash, bench, items_at_once=3)
    assert out.count() == 6 and {x["Found_by_text"] for x in out.collect()} == {"y"}
    assert decontaminate.decontaminate(d, bench.where("false")).where(F.size("items") > 0).count() == 0
    assert decontaminate.decontaminate(d.where("false"), bench).count() == 0


@pytest.mark.parametrize("room", [64 << 20, 0])
def test_line_dedup_of_clashing_names(spark, room):
    d = docs(spark, ["a\nb"] * 3 + [None]).withColumnRenamed("source", "text_hash").withColumnRenamed("lang", "Gone")
    out = lines.dedup_lines(d, min_docs=3, broadcast_bytes=room).collect()
    assert sorted((x["text"], x["text_hash"], x["Gone"]) for x in out) == [("", "s", "en")] * 4
    assert lines.dedup_lines(d.where("false"), broadcast_bytes=room).count() == 0


def test_mixing_of_values_named_like_the_pooled_one(spark):
    data = [(k, "w w", "en", ("(other)", "(null)", None, "=x")[k % 4]) for k in range(400)] + [(None, None, None, None)]
    out = mixture.mix_sources(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), {"source": {"(null)": 0.5, "=x": 0.5}}, keep=0.2)
    p = {(x["source"], x["mix_source"]): x["mix_probability"] for x in out.where("doc_id is not null").collect()}
    assert set(p) == {("(other)", "(other)"), ("(null)", "(null)"), (None, "(null)"), ("=x", "=x")}
    assert p["(other)", "(other)"] == 0 == p["(null)", "(null)"] and abs(p[None, "(null)"] - p["=x", "=x"]) < 0.01


def test_long_hidden_words(spark):
    words = ("idiot", "moron", "the", "and", "you", "are")
    model = toxicity.CharModel([(g, 50) for w in words for g in [f"^^{w}$"[i : i + 3] for i in range(len(w) + 1)]])
    assert "idiot" in toxicity.words_in("i" * 9 + "d" * 9 + "i" * 9 + "o" * 9 + "t" * 9, model)
    run = " ".join("youaretheidiotandyouarethemoronandyou")
    assert {"idiot", "moron"} <= set(toxicity.spaced_words(run, model))


def test_toxicity_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "a b"), (1, "you moron"), (1, "you moron"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels)
    assert toxicity.score_toxicity(d, model).count() == 4
    empty = toxicity.fit(d.where("false"), labels.where("false"))
    assert toxicity.score_toxicity(d.where("false"), empty).count() == 0 and 0 <= toxicity.score_toxicity(d, empty).first()["toxicity"] <= 1


A, B, C = (f"{w} long paragraph of running text, with enough words in it to be told from a menu." for w in ("First", "Second", "Third"))
MENU = "<ul>" + "".join(f"<li><a href=/{k}>Section {k}</a></li>" for k in range(5)) + "</ul>"
SHAPES = [
    (f"<nav>{MENU}</nav><article><h1>Head</h1><p>{A}</p><p>Yes.</p></article><footer>Imprint</footer>", f"Head {A} Yes."),
    (f"<article><p>{A}</p><p>{B}</p>{MENU}</article>", f"{A} {B}"),  # links behind the text: only the windows tell
    (f"<article>{MENU}<p>{A}</p><p>See <a href=x>this one</a></p><p><a href=y>Linked.</a></p><p>{B}</p></article>", f"{A} See this one Linked. {B}"),
    (f"<article><p>{A}</p></article><section id='comments'><article class='comment'><p>{B}</p></article></section>", A),
    (f"<article><p>{A}</p><ol class='commentlist'><li><article><p>{B}</p></article></li></ol></article>", A),
    (f"<main><article><p>{A}</p></article><article class='comment-body'><p>{B}</p></article></main><aside><article><p>{C}</p></article></aside>", A),
    (f"<article><div class='post-content has-sidebar search-result'><p>{A}</p></div></article>", A),
    (f"<div>{MENU}</div><div><p>{A}</p><p>{B}</p><nav>{MENU}</nav><p>Short.</p><p>{C}</p></div><div>(c) 2020</div>", f"{A} {B} Short. {C}"),
    (f"<div id='content'><p>{A}</p><div class='advert'>{B}</div><p>{C}</p></div><div>{B}</div>", f"{A} {C}"),
    (f"<div class='sidebar'><p>{B}</p></div><p>{A}", A),
    (f"<nav>{MENU}<article><p>{A}<p>{B}</article>", f"{A} {B}"),  # the menu is never closed
    (f"<article><header><h1>Title</h1></header><p>{A}<br>more</p><form><label>Mail</label><input></form><script>x='</article>'</script><table><tr><td>cell</table></article>", f"Title {A} more cell"),
    (f"<article><p>{A}</p><div hidden>{B}</div><div style='display:none'>{B}</div><div aria-hidden=true>{B}</div></article>", A),
    (f"<body><header>Site</header><section><h2>Head</h2><p>{A}</p></section><section class='related'><p>{B}</p></section><div class=footer-links>{MENU}</div>", f"Head {A}"),
    ("<p>&lt;b&gt; &#233;&nbsp;x\n y</p>", "<b> é x y"),
    (f"<article>{MENU}</article>", ""),
]


@pytest.mark.parametrize("k", range(len(SHAPES)))
def test_html_shapes(k):
    assert html.main_text(SHAPES[k][0]) == SHAPES[k][1]


def test_html_windows_decide(monkeypatch):
    """Without the windows, lists of links would stay."""
    monkeypatch.setattr(html, "runs", lambda lines, trim: [(0, len(lines))])
    assert sum(html.main_text(page) != text for page, text in SHAPES) >= 4


def test_html_of_odd_pages(spark):
    long = "<article>" + f"<p>{A}</p>" * 20000 + "</article>"
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, None, "<" * 5000), (3, "u", "<div class=ad>" * 3000 + "x")], "page_id long, url string, html string")
    out = html.extract_main_text(df).orderBy("page_id").collect()
    assert out[0] == out[1] and out[0]["text"] == " ".join([A] * 20000) and len(out) == 4
    assert html.extract_main_text(df.where("false")).count() == 0


def luhn_card(r):
    d = [4] + [r.randrange(10) for _ in range(14)]
    s = sum(sum(divmod(x * (2 - k % 2), 10)) for k, x in enumerate(d))
    return "".join(map(str, d)) + str(-s % 10)


def test_pii_trees_find_disguised_spans(spark):
    r, texts, hidden, decoys = random.Random(8), [], set(), set()
    for k in range(240):
        c, ip = luhn_card(r), ".".join(str(r.randrange(256)) for _ in range(4))
        phone = f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}"
        texts.append(f"{prose(k, 9)} u{k}@h{k % 9}.example.com {prose(k + 1, 6)} {c} {prose(k + 2, 6)} {ip} {prose(k + 3, 6)} {phone} {prose(k + 4, 5)}")
    for k in range(40):
        c, wrong = luhn_card(r), luhn_card(r)
        wrong = wrong[:-1] + str((int(wrong[-1]) + 3) % 10)
        phone = f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}"
        good = [f"name{k} (at) mail{k}.example.com", "[.]".join(str(r.randrange(256)) for _ in range(4)), "/".join(c[i : i + 4] for i in (0, 4, 8, 12)), phone]
        t = f"{prose(k, 5)} {good[0]} {prose(k, 4)} {good[1]} {prose(k, 4)} {good[2]} {prose(k, 4)} {phone} 10.0.0.{k} {prose(k, 4)} {wrong[:4]}/{wrong[4:8]}/{wrong[8:12]}/{wrong[12:]} end"
        hidden |= {(240 + k, kind, t.index(x), t.index(x) + len(x)) for kind, x in enumerate(good)}
        decoys.add((240 + k, 2, t.index(wrong[:4] + "/"), t.index(wrong[:4] + "/") + 19))
        texts.append(t)
    d = docs(spark, texts)
    extra = {(x["id"], x["kind"], x["start"], x["end"]) for x in pii.find_pii(d).where("not base").collect()}
    assert len(extra & hidden) >= 0.95 * len(hidden) and len(extra & hidden) >= 0.95 * len(extra) and not extra & decoys
    _, limits, measures = pii.fit_selector(pii.candidates(d))
    assert set(limits) == {0, 1, 2, 3} and all(p >= 0.98 and recall >= 0.9 for p, recall, _ in measures.values())
    out = {x["id"]: x for x in pii.pii_digest(d).collect()}
    assert all(out[i]["n_spans"] > out[i]["n_email"] + out[i]["n_ip"] + out[i]["n_card"] + out[i]["n_phone"] for i in range(240, 280))


def test_pii_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "a@b.com"), (None, "a@b.com"), (1, None), (1, "x 1.2.3.4")], "doc_id long, text string")
    out = sorted((repr(x["id"]), x["spans"]) for x in pii.pii_digest(d).collect())
    assert out == [("1", ""), ("1", "ip:2:9"), ("None", "email:0:7"), ("None", "email:0:7")]
    assert pii.pii_digest(d.where("false")).count() == 0
