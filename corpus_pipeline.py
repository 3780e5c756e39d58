"""The corpus pipeline: raw documents in, packed training sequences out.

Stages run in order; each works on all rows that its predecessor kept, and its output is written as Parquet and read
again before the next one. All but the last return the columns of `documents`, and whatever other columns came in.

Rows are judged one by one, never by their doc_id alone. A null text, or one without a letter, goes in language_id; so
does an empty one. A null doc_id is kept like any other: it comes last where near copies are chosen from, and its words
aren't compared in substring_dedup. Repeated rows are near copies of each other, so one stays. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm import common, langid, packing, quality, simhash, substring
from fathomry.llm.queries import tokenizer_file

#: The stages' results can't be expressed in SQL (compression, SimHash, BPE); tests compare them with plain versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly stay; `lang` is left as it was given."""
    return langid.clear(spark, docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the bounds of their language and source stay."""
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest doc_id, rows without a doc_id coming last."""
    rows = common.staged(spark, common.packed(docs).withColumn("n", F.monotonically_increasing_id()), "rows")
    groups = simhash.near_groups(spark, rows.select(F.col("n").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("n"), "component_id")
    order = F.struct(F.col("row.doc_id").isNull().alias("last"), F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("hash"), "n")
    first = rows.select("n", order.alias("order")).join(groups, "n").groupBy("component_id").agg(F.min("order").alias("order"))
    return rows.join(first.select("order.n"), "n", "left_semi").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go, the rest keeps its layout; a document of which nothing is left goes."""
    cut = substring.cut(spark, docs, layout=True).where("n_removed = 0 or n_words > n_removed")
    row = F.when(F.col("n_removed") == 0, F.col("row")).otherwise(F.col("row").withField("text", F.col("kept")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType)))
    return cut.select(row.alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or of its pieces, in sequences of 2048 tokens."""
    return packing.pack_documents(spark, docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.staged(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
