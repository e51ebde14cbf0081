"""All examples teach and calibrate."""

import random

import pyarrow as pa

import corpus_pipeline
from swerve.llm import common, jaccard, pii


def test_pii_selector_uses_all_examples(spark):
    """6,000 examples of one kind, more than the 2,000 a label once taken; held out is each fifth of a label."""
    r = random.Random(2)
    rows = [(k, 0, 0, None, 0, False, float(k % 3 == 0), [float(k % 3 == 0), r.random()]) for k in range(6000)]
    found = spark.createDataFrame(rows, pii.SCHEMA)
    model, limits, measures = pii.fit_selector(found)
    assert pii.examples(found).count() == 6000 and measures[0] == (1.0, 1.0, 1200) and limits[0] >= 0.5


def test_sparing_hands_on_every_row_in_parts():
    sizes, batch = [], pa.RecordBatch.from_arrays([pa.array(range(2500))], names=["x"])

    @common.sparing
    def run(batches):
        for b in batches:
            sizes.append(b.num_rows)
            yield b

    out = pa.Table.from_batches(list(run(iter([batch, batch.slice(0, 0), batch.slice(7, 3)]))))
    assert out.column("x").to_pylist() == [*range(2500), 7, 8, 9] and sizes == [1024, 1024, 452, 0, 3]


def test_copy_stage_joins_only_what_may_go(spark):
    """1 of 500 documents goes: nearly no text is joined, none is lost."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    rows = [(k, text(k), "en", "web", 9) for k in range(499)] + [(499, text(7), "en", "web", 9), (None, "", "en", "web", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sure, maybe = jaccard.split_by(docs, spark.createDataFrame([(499,)], "id long"))
    assert sure.count() + maybe.count() == 500 and [r["doc_id"] for r in maybe.collect()] == [499]
    kept = corpus_pipeline.keep_one_of_group(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*range(499), None], key=str)


def test_copy_stage_keeps_a_repeated_id_once(spark):
    """One text of id 5 is a copy of id 3's, the other is first of its group."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    docs = spark.createDataFrame([(3, text(3)), (5, text(3)), (5, text(5))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_group(spark, docs, "").collect()) == [3, 5]
