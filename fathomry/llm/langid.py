"""Language identification by compression.

Each language has a zstandard dictionary of raw content: whole texts of that language. A text is compressed with every
dictionary, block by block so that long texts can't teach the compressor their own language, and the language with
the smallest total wins; letters are lower-cased on both sides. A narrow margin over the second rejects the text.

The dictionaries are fitted on a bounded sample of labelled rows: per language at most SAMPLE_ROWS distinct texts of
up to SAMPLE_TEXT bytes, chosen by a hash of the doc_id among all labelled rows, and DICTIONARY bytes in all.
Predictions read nothing but the text. A null text, or one without any letter, is `und` and rejected. Of two languages
with equal sizes the first by name wins, with no margin, so the text is rejected. Repeated rows are predicted each, alike.
A null doc_id may be learned from. Without any labelled row everything is `und`; with one language only, its margin is
clear. An empty table gives an empty result. Extra columns are kept, whatever their names, but for those of the columns
that are added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import common

SAMPLE_ROWS, SAMPLE_TEXT, DICTIONARY = 256, 8192, 112 << 10
#: Bytes of a text that are compressed together.
BLOCK = 4096
LEVEL = 6
#: A text is rejected if the second language needs less than this share more.
MARGIN = 0.004


def dictionaries(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Raw content of each language's dictionary, from (doc_id, text, lang)."""
    fit = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= SAMPLE_TEXT))
    fit = fit.select("lang", "text", F.xxhash64("doc_id").alias("h"))
    # thin by hash to about twice the sample before the rows of a language meet
    share = F.broadcast(fit.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * rows) / F.count("*")).alias("share")))  # one row for each language
    thin = fit.join(share, "lang").where((F.pmod("h", F.lit(1 << 30)) / (1 << 30)) < F.col("share"))
    thin = thin.groupBy("lang", "text").agg(F.min("h").alias("h"))
    ranked = thin.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= rows)
    # what doesn't fit into a dictionary isn't collected
    before = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("n")) - F.octet_length("text")
    ranked = ranked.withColumn("before", before).where(F.col("before") <= DICTIONARY)
    out: dict[str, list[bytes]] = {}
    for r in ranked.orderBy("lang", "n").collect():  # bounded: DICTIONARY + SAMPLE_TEXT bytes a language
        out.setdefault(r["lang"], []).append(r["text"].lower().encode())
    return {lang: b"\n".join(texts)[:DICTIONARY] for lang, texts in out.items()}


class Classifier:
    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.languages = sorted(contents)
        self.compressors = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=content, level=level, write_content_size=False, write_checksum=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); the score is the margin's share of a clear one."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        raw = text.lower().encode()
        n = max(1, -(-len(raw) // BLOCK))
        step = -(-len(raw) // n)
        blocks = [raw[i : i + step] for i in range(0, len(raw), step)]
        sizes = sorted((sum(len(compress(b)) for b in blocks), lang) for lang, compress in zip(self.languages, self.compressors, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], min(1.0, 10 * margin), margin


def _predicted(spark: SparkSession, docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """(row, lang_pred, score, margin, rejected) of all rows of `docs`; `row` has their columns."""
    text = common.field_of(docs, "text")
    shared = spark.sparkContext.broadcast(contents)  # DICTIONARY bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        for batch in common.text_slices(batches, text=text):
            lang, score, margin = zip(*map(classify, text(batch).to_pylist()), strict=True)
            more = [pa.array(lang), pa.array(score), pa.array(margin), pa.array([m < MARGIN for m in margin])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["row", *ADDED])

    kinds = (StringType(), DoubleType(), DoubleType(), BooleanType())
    return common.packed(docs).mapInArrow(run, StructType([StructField("row", docs.schema), *map(StructField, ADDED, kinds)]))


ADDED = ("lang_pred", "score", "margin", "rejected")


def predict(spark: SparkSession, docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """All rows of `docs` with `lang_pred`, `score`, `margin` and `rejected` added."""
    return _predicted(spark, docs.drop(*ADDED), contents).select("row.*", *ADDED)


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fits on the rows that aren't held out and predicts all."""
    return predict(spark, docs, dictionaries(docs.where(~held_out())))


def clear(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of `docs` that aren't rejected, with their columns."""
    return _predicted(spark, docs, dictionaries(docs.where(~held_out()))).where("not rejected").select("row.*")
