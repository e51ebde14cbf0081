import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swerve.llm import alignment, bitmaps, languages, queries, resampling
from tests.compare import connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, row string, id string, score string, n string, rank string, a string, chunk string"
ODD = [None, "", " ", "\n", "a ", "  two  spaces \n and\tmore\n\n\n end  ", "<s>x</s><|endoftext|> y", "a▁b ▁", "naïve ½ ² ﬁ x　y", "\r\n;\r", "日本語のテキスト 🙂🙂", "x" * 3000, "\x00\x1c", "don't  we'll\n 's", "Ａ " * 50, "word " * 700]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", *"xyzvwuq") for k, t in enumerate(texts)], DOCS)


def some_texts():
    return [r[0] for r in connect(SF).sql("select text from documents order by doc_id limit 60").fetchall()]


@pytest.mark.parametrize("seed", range(4))
def test_bitmaps(seed):
    r = np.random.default_rng(seed)
    sets = [np.unique(r.integers(0, int(r.choice([9, 300, 65536])), int(r.choice([1, 5, 4000])))) for _ in range(200)] + [np.arange(65536), np.array([65535]), np.array([0])]
    sets = [sets[i] for i in r.permutation(len(sets))]
    begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
    bits, dense = bitmaps.encode(np.concatenate(sets), begins)
    assert 0 < dense.sum() < len(sets)
    assert max(len(x.as_py()) for x in bits) <= 8192
    for lo, hi in ((0, len(sets)), (50, 120)):
        which, numbers = bitmaps.decode(bits.slice(lo, hi - lo), dense[lo:hi])
        assert which.tolist() == [i for i, s in enumerate(sets[lo:hi]) for _ in s] and numbers.tolist() == np.concatenate(sets[lo:hi]).tolist()


def brute_alignment(texts):
    """Whole texts through the libraries, links as lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.vocabulary_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path(queries.PIECES))
    of = {c: bytes([x]) for c, x in alignment.byte_of_character().items()}
    name = {i: t for t, i in a.get_vocab().items()}
    linked = []
    for t in texts:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ba = [b"".join(of[c] for c in name[i]) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        if not t or b"".join(ba) != b"".join(bb) or b"".join(ba) != (" " + t).encode():
            linked.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        ends = sorted(set(ea) & set(eb))
        groups = [([i for i, e in zip(ia, ea) if lo < e <= hi], [i for i, e in zip(ib, eb) if lo < e <= hi]) for lo, hi in zip([0, *ends], ends)]
        linked.append((ia, ib, groups, [(x, y) for p, q in groups for x in p for y in q]))
    held, links = Counter(), Counter()
    for x in linked:
        held.update(set(x[3]) if x else ())
        links.update(x[3] if x else ())
    highest = defaultdict(int)
    for (p, _), n in held.items():
        highest[p] = max(highest[p], n)
    out = []
    for k, x in enumerate(linked):
        if x is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in x[2])
        out.append((k, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(held[l] == highest[l[0]] for l in x[3]), sum(held[l] for l in x[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out, {(p, q): (n, links[p, q], n == highest[p]) for (p, q), n in held.items()}


@pytest.mark.parametrize("links", [1 << 21, 500])
def test_alignment_against_brute_force(spark, links):
    texts = ODD + some_texts() + ["word " * 700, "one two"] * 30
    found, pairs = alignment.align_tokens(docs(spark, texts).repartition(3), queries.vocabulary_path(), queries.vocabulary_path(queries.PIECES), links)
    rows, by_pair = brute_alignment(texts)
    assert sorted(tuple(r) for r in found.collect()) == rows
    assert {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in pairs.collect()} == by_pair


def test_alignment_merges_bitmaps():
    """Parts of one pair, chunk and plane become their OR; a batch may end inside a pair."""
    rows = [(1, 2, 0, 0, [1, 5]), (1, 2, 0, 0, [5, 9]), (1, 2, 0, 1, [5]), (1, 2, 7, 0, [3]), (1, 3, 0, 2, [4, 6])]
    bits = [bitmaps.encode(np.array(n), np.array([0])) for *_, n in rows]
    batch = pa.RecordBatch.from_pylist([{"a": a, "b": b, "chunk": c, "plane": p, "dense": bool(d[0]), "bits": x[0].as_py()} for (a, b, c, p, _), (x, d) in zip(rows, bits)])
    for size in (1, 2, 5):
        out = pa.Table.from_batches(list(alignment._merge([batch.slice(k, size) for k in range(0, 5, size)]))).to_pylist()
        assert [(r["a"], r["b"], r["chunk"], r["plane"], r["docs"], r["links"]) for r in out] == [(1, 2, 0, 0, 3, 3), (1, 2, 0, 1, 0, 2), (1, 2, 7, 0, 1, 1), (1, 3, 0, 2, 2, 8)]


def test_alignment_encodes_a_segment_once(monkeypatch):
    """Segments of many texts are encoded once by a worker, not each time that they come again."""
    paths = queries.vocabulary_path(), queries.vocabulary_path(queries.PIECES)
    made, encoded = alignment.Aligner(*paths), []
    monkeypatch.setattr(made, "encode_a", lambda x, f=made.encode_a: encoded.extend(x) or f(x))
    monkeypatch.setattr(alignment, "_state", {"paths": paths, "made": made})
    monkeypatch.setattr(alignment.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 1})())
    words = ["".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(300_000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(300)), "text": [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]})
    out = pa.Table.from_batches(list(alignment._scan(*paths, 1 << 21)([batch, batch]))).to_pylist()
    assert len(encoded) == len(set(encoded)) == len(words)
    hashes = [r["groups_sha256"] for r in out if r["row"] is not None]
    assert len(hashes) == 600 and hashes[:300] == hashes[300:]


def test_alignment_of_odd_tables(spark):
    paths = queries.vocabulary_path(), queries.vocabulary_path(queries.PIECES)
    found, pairs = alignment.align_tokens(docs(spark, []), *paths)
    assert found.count() == 0 and pairs.count() == 0
    twice = docs(spark, ["one two", "one two"]).withColumn("doc_id", F.lit(None).cast("long"))
    found, pairs = alignment.align_tokens(twice, *paths)
    assert [r.count_sum > 0 and r.id is None for r in found.collect()] == [True, True] and {r.n_docs for r in pairs.collect()} == {2}


def test_language_held_out(spark):
    truth = dict(connect("/root/testdata/sf0.01").sql("select doc_id, lang from documents").fetchall())
    got = queries.op11_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    sure = [r for r in held if r.accepted]
    assert len(sure) > 0.9 * len(held) and np.mean([truth[r.doc_id] == r.lang_pred for r in sure]) > 0.99


def test_language_against_plain_coders(spark):
    """The same sizes from dictionaries made again of sorted pieces, outside Spark."""
    texts = [*some_texts(), *some_texts(), None, "", "12 34 !", "x", "é", "日本", "a" * 200000]
    langs = ["en" if k % 2 else "fr" for k in range(len(texts) - 7)] + [None] * 7
    rows = spark.createDataFrame(list(zip(langs, texts)), "lang string, text string")
    made = languages.fit(rows, 4096)
    plain = {}
    for lang in ("en", "fr"):
        pieces = {x[k : k + 256] for v, t in zip(langs, texts) if v == lang for x in [languages.letters_of(t)] for k in range(0, len(x), 256)}
        data = "".join(sorted(pieces, key=lambda p: (languages.xxhash.xxh64_intdigest(p) >> 1, p))).encode()
        plain[lang] = data[:4096].decode("utf-8", "ignore").encode()
    assert made == plain
    got = sorted(tuple(r) for r in languages.predict_languages(docs(spark, texts), made).collect())
    coder = languages.Sizes(plain)
    for k, lang, score, accepted in got:
        data = languages.letters_of(texts[k]).encode()
        if not any(c.isalpha() for c in texts[k] or ""):
            assert (lang, score, accepted) == ("und", 0.0, False)
        else:
            sizes = dict(zip(coder.langs, coder.of(data)))
            assert lang == min(sizes, key=lambda v: (sizes[v], v)) and 0.5 <= score <= 1
            assert accepted == (max(sizes.values()) - min(sizes.values()) >= max(2, 0.01 * min(sizes.values())))


def test_language_of_odd_tables(spark):
    assert languages.predict_languages(docs(spark, []), {"en": b"x" * 99}).count() == 0
    assert [tuple(r)[1:] for r in languages.predict_languages(docs(spark, ["one", None]), {}).collect()] == [("und", 0.0, False)] * 2
    assert languages.fit(spark.createDataFrame([(None, "a"), ("en", None), ("de", "12")], "lang string, text string")) == {}
    one = languages.fit(spark.createDataFrame([("en", "the same text ")] * 500, "lang string, text string"))
    assert one == {"en": b" the same text "}
    assert languages.predict_languages(docs(spark, ["text"]), one).first()["lang_pred"] == "en"


def brute_resampling(rows, target, percent=10, least=20, grams=(1, 1)):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def buckets(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(grams[0], grams[1] + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in side for b in buckets(x)) for side in ([x for _, x in rows], target))
    ns, nt, out = sum(s.values()), sum(t.values()), []
    for i, x in rows:
        g = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in buckets(x)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = [k for k, (_, x) in enumerate(rows) if len(words(x)) >= least]
    order = sorted(fit, key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))[: percent * len(fit) // 100]
    return [(*o, order.index(k) + 1 if k in order else None) for k, o in enumerate(out)]


@pytest.mark.parametrize("grams, percent", [((1, 1), 10), ((1, 2), 50), ((2, 3), 100)])
def test_resampling_against_brute_force(spark, grams, percent):
    rows = list(enumerate(some_texts() + ODD))
    target = some_texts()[:3] + [None, ""]
    got = resampling.resample(docs(spark, [t for _, t in rows]), spark.createDataFrame([(t,) for t in target], "text string"), percent, grams=grams)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == brute_resampling(rows, target, percent, grams=grams)


def test_resampling_ties_and_repeats(spark):
    """Equal rows, equal ids and null ids: the number of drawn rows is exact and ranks have no gap."""
    text = "word " * 25
    ids = [7] * 30 + [None] * 30 + [3] * 15 + list(range(100, 125))
    rows = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").repartition(4)
    empty = spark.createDataFrame([], "text string")
    for percent in (1, 29, 55):
        got = resampling.resample(rows, empty, percent).collect()
        want = [r[3] for r in sorted(brute_resampling([(i, text) for i in ids], [], 100), key=lambda r: r[4])][: percent]
        drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
        assert len(got) == 100 and [r["rank"] for r in drawn] == list(range(1, percent + 1)) and [r["score"] for r in drawn] == want
    assert resampling.resample(rows.limit(0), empty).count() == 0
    assert {r["rank"] for r in resampling.resample(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string"), rows).collect()} == {None}


@pytest.mark.parametrize("points", [1, 2, 15])
def test_cut_point(spark, points):
    r = random.Random(points)
    values = [(r.choice([-5, 0, 9, 1000]), r.randrange(4), k) for k in range(300)]
    rows = spark.createDataFrame(values, "x long, y long, z long")
    keys = [F.col(c) for c in "xyz"]
    for k in (1, 150, 300):
        at = resampling.cut_point(rows, keys, k, points)
        assert sorted(tuple(v) for v in rows.where(resampling.within(keys, at)).collect()) == sorted(values)[:k]
