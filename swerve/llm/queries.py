"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as bench
from . import alignment, html, jaccard, languages, licences, lines, mixture, pii, resampling, tokens, topk, toxicity
from .common import crc_mod, table

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return toxicity.score_toxicity(docs, model).select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary_path()).withColumnRenamed("id", "doc_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.topk_by_histogram(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bench.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items")
    return found.select(F.col("id").alias("doc_id"), (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("item_ids"), F.coalesce(F.array_max("similarities"), F.lit(0.0)).alias("similarity"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_weight").cast("long").alias("n_words"), F.round("mix_probability", 9).alias("probability"), F.col("mix_sampled").alias("sampled"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0
    dictionaries = languages.fit(languages.labelled(docs, ~held))
    found = languages.predict_languages(docs.select("doc_id", "text"), dictionaries)
    return found.withColumnRenamed("id", "doc_id").select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = alignment.align_tokens(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path(PIECES))
    return found.withColumnRenamed("id", "doc_id")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ngram_jaccard, op3_line_dedup, op4_token_counts, op5_html_extraction, op6_pii, op7_topk_search, op8_licence_scan, op9_decontamination, op10_source_mixing, op11_language_id, op12_token_alignment, op13_importance_resampling)}

ORACLES = {
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, sh, len(sh) AS n_shingles FROM s),
x AS (SELECT doc_id, n_shingles, unnest(sh) AS g FROM n),
r AS (SELECT doc_id, n_shingles, g FROM x WHERE g IN (SELECT g FROM x GROUP BY g HAVING count(*) > 1)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n_shingles) AS na, any_value(b.n_shingles) AS nb, count(*) AS i FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT n.doc_id, n.n_shingles::BIGINT AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM c GROUP BY a) m ON n.doc_id = m.a""",
    "op3_line_dedup": r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT doc_id, ls, list_transform(ls, lambda x: translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ks FROM t),
f AS (SELECT key FROM (SELECT doc_id, unnest(list_distinct(ks)) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
i AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line, unnest(ks) AS key FROM k),
j AS (SELECT i.doc_id, i.n, i.line, f.key IS NOT NULL AS gone FROM i LEFT JOIN f ON i.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op7_topk_search": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op13_importance_resampling": r"""
WITH RECURSIVE byte AS (SELECT unnest(range(256)) AS v, v AS c, 0 AS k),
step AS (SELECT v, c, k FROM byte UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c::BIGINT ORDER BY v) AS t FROM step WHERE k = 8),
w AS (SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
x AS (SELECT side, doc_id, unnest(ws) AS word FROM w),
h AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM x)),
b AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) % 10000 AS bucket FROM h, crc),
y AS (SELECT side, doc_id, bucket FROM x JOIN b USING (word)),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM y GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM n),
g AS (SELECT n.bucket, floor(1000 * ln((n.t + 1) * (a.s + 10000) / ((n.s + 1) * (a.t + 10000)))) AS gain FROM n, a),
f AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM y JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
d AS (SELECT w.doc_id, coalesce(f.n, 0) AS n_features, coalesce(f.weight, 0)::BIGINT AS weight, len(ws) AS words, ('0x' || sha256('2024:' || w.doc_id)[1:8])::BIGINT AS h FROM w LEFT JOIN f ON w.doc_id = f.doc_id WHERE side = 'd'),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE words >= 20),
k AS (SELECT 10 * count(*) // 100 AS k FROM r)
SELECT e.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM e LEFT JOIN r ON e.doc_id = r.doc_id, k""",
}
