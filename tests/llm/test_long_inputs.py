"""Long items, pages of open tags, chains of overlapping detections."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from swerve.llm import decontaminate as D
from swerve.llm import html as H
from swerve.llm import licences as L
from swerve.llm.common import WordHasher, shingles_of, text_arrays


def hits_of(items, docs):
    bench, hasher = D.Benchmark(items), WordHasher()
    data, offsets = text_arrays(pa.array(docs))
    words, _, _, at = hasher.words(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    for a, b in zip(at[:-1], at[1:], strict=True):
        s = shingles_of(words[a:b], D.SIZE)
        yield bench.search(words[a:b], s, bench.hits(s), D.SIMILARITY)


def test_long_item_takes_little_memory():
    item = [f"q{k}" for k in range(20_000)]
    doc = [f"a{k}" for k in range(9_000)] + item + [f"b{k}" for k in range(9_000)]
    tracemalloc.start()
    found = list(hits_of([(1, " ".join(item))], [" ".join(doc), " ".join(item)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [{1: (1.0, 9_000, 29_000)}, {1: (1.0, 0, 20_000)}]
    assert peak < 200e6


def test_rolling_fingerprints_are_those_of_each_window():
    rng = np.random.default_rng(5)
    shingles = rng.integers(0, 2**64, 6_000, dtype=np.uint64)
    for span in (1, 2, 7, 50):
        first = np.flatnonzero(rng.random(6_000 - span + 1) < 0.9)
        want = []
        for a in first.tolist():
            bits = (shingles[a : a + span, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            want.append(sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > span))
        assert D.simhashes(shingles, first, span).tolist() == want


def test_pages_of_open_tags_take_linear_time():
    for unit in ("<a ", '<a "', "<a '\"", "<svg>", "<!x", '</a "', "<head>", '<p class="'):
        for tail in ("", "'", '">'):
            begin = time.monotonic()
            H.main_text(unit * (1_000_000 // len(unit)) + tail)
            assert time.monotonic() - begin < 10, (unit, tail)


def test_tags_with_quoted_signs():
    page = "<p title='a > b'>One <i class=\"x<y>z\">two</i> three</p><!-- <p>no --><br/>four"
    assert [(t[2], t[3]) for t in H.elements(page)] == [("p", False), ("i", False), ("i", True), ("p", True), ("", False), ("br", False)]


def test_references_of_many_digits():
    assert H.decoded("&#" + "9" * 5_000 + "; &#" + "0" * 5_000 + "65; &lt;&#66") == "� A <B"


def test_what_is_put_out_puts_out_nothing(spark):
    signatures = [("aa", "aa bb", "aa bb", "x", 1, 0.5), ("bb", "bb cc", "bb cc", "y", 2, 0.5), ("cc", "cc dd", "cc dd", "z", 3, 0.5)]
    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, "aa bb cc"), (3, None), (4, "")], "i int, text string")
    got = {r["i"]: [x["label"] for x in r["f"]] for r in docs.select("i", L.detections(docs["text"], signatures).alias("f")).collect()}
    assert got == {1: ["x", "z"], 2: ["y"], 3: [], 4: []}


def test_suppression_is_best_first(spark):
    rng, rows = random.Random(2), []
    for k in range(300):
        starts = sorted(rng.randrange(60) for _ in range(rng.randrange(25)))
        rows.append((k, [(a, a + rng.randrange(1, 8), "l", (rng.randrange(500) * 100 + n) * 1000, 0.5) for n, a in enumerate(starts)]))
    spans = spark.createDataFrame(rows, f"k int, s array<{L.DETECTION}>")
    for r in spans.select("s", L.undisputed(spans["s"]).alias("o")).collect():
        kept = []
        for x in sorted(r["s"], key=lambda x: (x["priority"] // L.FORM, x["end"] - x["start"], x["priority"]), reverse=True):
            if all(y["end"] <= x["start"] or x["end"] <= y["start"] for y in kept):
                kept.append(x)
        assert sorted(kept) == r["o"]


def test_identifiers_and_expressions(spark):
    texts = {
        "GPL-3.0-or-later": "gpl-3.0",
        "SPDX-License-Identifier: Apache-2.0 OR MIT": "apache-2.0,mit",
        "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND ISC": "gpl-2.0,isc",
        "under LGPL-2.1+.": "lgpl-2.1",
        "MIT OR nothing": "",
        "FGPL-3.01": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["id"]: r["labels"] for r in L.scan_licences(docs).collect()}
    assert got == dict(enumerate(texts.values()))
