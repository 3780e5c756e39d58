"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, langid, license_scan, lm, packing, quality, simhash, substring, token_io
from .common import documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids"
    )
    return bpe.decode_documents(encoded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return langid.identify(spark, docs).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring.dedup(spark, docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_io.token_files(spark, documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(b) for b in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, documents(spark, sf_dir).select("doc_id", "text"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, documents(spark, sf_dir).select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(spark, documents(spark, sf_dir).select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_language_id, op3_substring_dedup, op4_embedding_dedup, op5_token_files, op6_lm_scoring, op7_license_scan, op8_quality_rules, op9_best_fit_packing, op10_simhash)}


def _license_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(license_scan.TEMPLATES))
    norm = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}{}]+', ' ', 'g'))"
    grams = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
    t = license_scan.DICE
    return f"""
WITH notices(template, license, notice) AS (VALUES {rows}),
known AS (SELECT template, license, len(words) - 1 AS size, unnest({grams}) AS bigram
          FROM (SELECT template, license, string_split({norm.format('notice', '')}, ' ') AS words FROM notices)),
counted AS (SELECT template, license, size, bigram, count(*) AS times FROM known GROUP BY ALL),
texts AS (SELECT doc_id, {norm.format('text', chr(92) + 'n')} AS t FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS u FROM texts UNION ALL SELECT doc_id, t FROM texts
          UNION ALL SELECT doc_id, unnest(regexp_split_to_array(t, '\\n ?\\n[\\n ]*')) FROM texts WHERE regexp_matches(t, '\\n ?\\n')
          UNION ALL SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[.!?]+[ \\t]+|\\n')) FROM documents),
flat AS (SELECT DISTINCT doc_id, {norm.format('u', '')} AS unit FROM parts),
cut AS (SELECT doc_id, unit, string_split(unit, ' ') AS words FROM flat),
grams AS (SELECT doc_id, unit, len(words) - 1 AS unit_size, unnest({grams}) AS bigram FROM cut
          WHERE len(words) - 1 BETWEEN (SELECT min(size) * {t / (2 - t)} FROM counted) AND (SELECT max(size) / {t / (2 - t)} FROM counted)),
shared AS (SELECT doc_id, unit, unit_size, template, license, size, g.bigram, times, count(*) AS n
           FROM grams g JOIN counted c ON g.bigram = c.bigram GROUP BY ALL),
scored AS (SELECT doc_id, unit, template, license, 2 * sum(least(n, times)) / (unit_size + size) AS dice
           FROM shared GROUP BY doc_id, unit, unit_size, template, license, size),
best AS (SELECT doc_id, unit, license, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, template) AS k,
         dense_rank() OVER (PARTITION BY doc_id ORDER BY unit) AS u FROM scored WHERE dice >= {t}),
top AS (SELECT doc_id, max(license) FILTER (k = 1) AS license, max(dice) AS dice, max(u) AS n_units FROM best GROUP BY doc_id)
SELECT d.doc_id, license, CAST(dice AS DOUBLE) AS dice, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN top ON d.doc_id = top.doc_id
"""


SUBSTRING_SQL = """
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
wins AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM texts),
keyed AS (SELECT w.doc_id, w.i, md5(array_to_string(t.words[w.i:w.i + 12], ' ')) AS k FROM wins w JOIN texts t USING (doc_id)),
low AS (SELECT k, min(doc_id) AS first_id FROM keyed GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM keyed JOIN low USING (k) WHERE first_id < doc_id),
per AS (SELECT doc_id, list(i) AS out FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(coalesce(len(p.out), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN p.out IS NULL THEN t.words ELSE
         list_transform(list_filter(range(1, len(t.words) + 1), lambda j: NOT list_contains(p.out, j)), lambda j: t.words[j]) END, ' '), '')) AS kept_sha256
FROM texts t LEFT JOIN per p ON t.doc_id = p.doc_id
"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(comp.low, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(comp.low, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN comp ON comp.a = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": SUBSTRING_SQL, "op4_embedding_dedup": EMBEDDING_SQL, "op7_license_scan": _license_sql()}
