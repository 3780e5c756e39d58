"""Quality rules with adaptive thresholds.

Every text is measured: words, word characters, symbols, repeated lines, and words in repeated windows. Fixed cut-offs
decide only what no corpus would keep (BASE rule). The rest is decided against the text's own kind: a mergeable
quantile sketch of each measure is kept for each language and source, sketches of a language merge into one for
sources with few rows, and these into one for all; a measure is out of bounds if it lies further from its group's
median than so many times the distance of a quantile in the tail (or of a floor, where a group doesn't vary at all).
Thresholds are joined to the rows by language and source.

A sketch counts rows in bins that grow by a fixed factor, so a quantile is off by ERROR of its value at most. Merging
adds counts: the result is the same in whatever order rows and tasks come, and for every run. A sketch has some
thousand bins at most, however many rows it counts.

Texts: null counts as no words, and fails the base rule. Null languages and sources are a group like any other.
Repeated rows are judged each; a null doc_id is a row like any other; an empty table gives an empty result. Extra
columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

WINDOW = 5
#: Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 10, 20
#: Rows that a group must have to be judged by its own sketch.
LEAST_ROWS = 200
#: How far off a quantile may be, as a share of its value.
ERROR = 0.005
#: Measures with the quantile of the tail, how many times its distance from the median is within bounds, the least
#: distance that counts, and whether low values are out of bounds too. Where junk itself makes up part of a tail
#: (symbols, long words) the quantile lies before it.
MEASURES = {"symbol_rate": (0.8, 4.0, 0.02, False), "dup_line_rate": (0.99, 2.0, 0.02, False), "repeat_rate": (0.99, 2.0, 0.01, False), "word_length": (0.9, 4.0, 0.05, True)}

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(raw: np.ndarray, ends: np.ndarray, digests: common.Digests) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words of texts laid end to end."""
    starts, stops, bounds = common.word_spans(raw, ends)
    n_words = np.diff(bounds)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[ends])
    word_byte = ~common._IS_BLANK[raw]
    first, windows = common.window_hashes(np.ascontiguousarray(digests.of(raw, starts, stops)[:, 0]), bounds, WINDOW)
    # windows of a row that stand there twice: sorted by row and hash
    row = np.searchsorted(bounds, first, "right") - 1
    order = np.lexsort((windows, row))
    same = (windows[order][1:] == windows[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    flagged = first[order[twice]]
    edge = np.zeros(len(starts) + 1, np.int32)
    np.add.at(edge, flagged, 1)
    np.add.at(edge, flagged + WINDOW, -1)
    repeat = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])[bounds])
    data, cuts = raw.tobytes(), ends.tolist()
    texts = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return {
        "n_words": n_words,
        "word_chars": sums(word_byte & ((raw & 0xC0) != 0x80)),
        "n_symbols": sums(_IS_SYMBOL[raw]),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
        "n_lines": sums(raw == 10) + (n_words > 0),
        "n_repeat_words": repeat,
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def measured(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(row, lang, source, and COUNTS) of every row; `row` is all of it, or with its doc_id alone if it isn't asked for whole."""
    rows = docs if whole else docs.select("doc_id", "lang", "source", "text")
    fields = dict(zip(("text", "lang", "source", "doc_id"), (common.field_of(rows, c) for c in ("text", "lang", "source", "doc_id")), strict=True))
    key = secrets.token_bytes(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = common.digests_of(key)
        for batch in common.text_slices(batches, text=fields["text"]):
            got = measure(*common.text_bytes(fields["text"](batch)), digests)
            row = batch.column(0) if whole else pa.StructArray.from_arrays([fields["doc_id"](batch)], ["doc_id"])
            yield pa.RecordBatch.from_arrays([row, fields["lang"](batch), fields["source"](batch), *(pa.array(got[n], pa.int64()) for n in COUNTS)], names=["row", "lang", "source", *COUNTS])

    row = docs.schema if whole else StructType([docs.schema["doc_id"]])
    schema = StructType([StructField("row", row), StructField("lang", StringType()), StructField("source", StringType()), *(StructField(n, LongType()) for n in COUNTS)])
    return common.packed(rows).mapInArrow(run, schema)


def rated(counts: DataFrame) -> DataFrame:
    """Adds the MEASURES and `base_failed`."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return counts.withColumns(
        {
            "symbol_rate": F.col("n_symbols") / words,
            "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_rate": F.col("n_repeat_words") / words,
            "word_length": F.col("word_chars") / words,
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        }
    )


GROWTH = (1 + ERROR) / (1 - ERROR)


def bin_of(value: Column) -> Column:
    """The bin of a value, which isn't negative; zero has one of its own."""
    return F.when(value > 0, F.ceil(F.log(value) / math.log(GROWTH))).otherwise(F.lit(-(1 << 31)))


def value_of(bin: Column) -> Column:
    return F.when(bin == -(1 << 31), F.lit(0.0)).otherwise(2 * F.pow(F.lit(GROWTH), bin) / (GROWTH + 1))


def _quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, and for each measure its median, upper and lower quantile) of sketches (keys, measure, bin, n)."""
    merged = sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "rows": F.sum("n").over(group)})
    at = lambda m, q: value_of(F.min(F.when((F.col("measure") == m) & (F.col("upto") >= q * F.col("rows")), F.col("bin"))))
    columns = [F.max("rows").alias("rows")]
    for m, (tail, *_) in MEASURES.items():
        columns.append(F.struct(at(m, 0.5).alias("middle"), at(m, tail).alias("high"), at(m, 1 - tail).alias("low")).alias(m))
    return ranked.groupBy(*keys).agg(*columns)


def thresholds(rates: DataFrame) -> DataFrame:
    """(lang, source, and low and high bounds of each measure) for every language and source."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).alias("bin")) for m in MEASURES])).alias("x")
    sketches = rates.select("lang", "source", each).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))
    g, by_lang, overall = (_quantiles(sketches, keys) for keys in (["lang", "source"], ["lang"], []))
    out = g.alias("g").join(by_lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang"))).crossJoin(F.broadcast(overall).alias("o"))  # one row
    columns = [F.col("g.lang").alias("lang"), F.col("g.source").alias("source")]
    for m, (_, times, floor, both) in MEASURES.items():
        q = F.when(F.col("g.rows") >= LEAST_ROWS, F.col(f"g.{m}")).when(F.col("l.rows") >= LEAST_ROWS, F.col(f"l.{m}")).otherwise(F.col(f"o.{m}"))
        middle = q["middle"]
        columns.append((middle + times * F.greatest(q["high"] - middle, F.lit(floor))).alias(f"high_{m}"))
        columns.append((middle - times * F.greatest(middle - q["low"], F.lit(floor)) if both else F.lit(float("-inf"))).alias(f"low_{m}"))
    return out.select(*columns)


def _verdicts(rates: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds `kept`: not failed by the base rule, and all measures within the bounds of the row's language and source."""
    bounds = bounds.withColumnsRenamed({"lang": "lang_", "source": "source_"})
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    joined = rates.join(bounds, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop(*bounds.columns)


def _learned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rates of every row, and the bounds, learned from what passes the base rule; both staged."""
    spark = docs.sparkSession
    rates = rated(common.staged(spark, measured(docs), "measures"))
    return rates, common.staged(spark, thresholds(rates.where("not base_failed")), "bounds")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, COUNTS, MEASURES, base_failed, kept) of every row."""
    out = _verdicts(*_learned(docs))
    return out.select("row.doc_id", *[c for c in out.columns if c != "row"])


def kept(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with their columns. Texts are measured a second time, so that none is shuffled."""
    _, bounds = _learned(docs)
    return _verdicts(rated(measured(docs, whole=True)), bounds).where("kept").select("row.*")
