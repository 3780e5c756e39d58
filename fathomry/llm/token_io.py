"""Token ids in binary files: frequency-ranked ids, byte-aligned codes of variable length, control bytes apart.

A token file is a Parquet folder of blocks. A block holds whole documents in ascending doc_id order: their ids
replaced by frequency ranks (0: the most frequent id of all files), `data` with 1 to 4 bytes a rank, and `control`
with two bits a rank that tell how many. A folder beside it holds the ids in rank order. Blocks are decoded with
numpy: a table gives the four lengths of a control byte, and masks cut the codes out of the data.

Null texts count as empty; each document ends with `end_id`. Rows of one doc_id follow each other, in an order that
their ids alone decide; null doc_ids come first. Repeated rows are written as often as they stand. Columns other than doc_id and text are
not read. An empty table gives no blocks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, pretokenize

#: Ids in one block; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: Bytes of text taken at a time: the larger, the more repeated pieces are looked up once.
TOKENIZE_BYTES = 1 << 20


class LibraryTokenizer:
    """A byte-level BPE file of the tokenizers library; the library merges each distinct piece, and pieces are kept.

    As in the library, the file's added tokens are cut out of a text before all else and have their own ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        before = tokenizer.pre_tokenizer
        if not isinstance(before, ByteLevel) or not before.use_regex or before.add_prefix_space or tokenizer.normalizer:
            raise ValueError("a byte-level BPE without normaliser and prefix space is asked for")
        self.added = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that depend on what stands around them aren't read")
        # the longest first: of tokens that begin at one place the library takes the longest
        self.found = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.vocabulary = tokenizer.get_vocab_size()
        model = tokenizer.model
        # the library writes byte b as the character that stands for it in its vocabulary
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

        def merge(pieces: list[bytes]) -> list[list[int]]:
            text = b"".join(pieces).decode("latin-1").translate(letters)
            at, out = 0, []
            for size in map(len, pieces):
                out.append([t.id for t in model.tokenize(text[at : at + size])])
                at += size
            return out

        self.cache = pretokenize.PieceCache(merge)

    def encode(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts laid end to end: (ids, the n + 1 offsets of the rows' ids)."""
        spans = self._added_in(raw, ends)
        if not spans:
            return self.cache.encode(raw, ends)[:2]
        # what stands between added tokens is encoded like rows of its own
        begin, end, ids_of = (np.array(x, np.int64) for x in zip(*spans, strict=True))
        cuts = np.unique(np.concatenate([ends, begin, end]))
        outside = np.ones(len(raw), bool)
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            outside[a:b] = False
        kept = np.concatenate([[0], np.cumsum(outside)])
        ids, offsets = self.cache.encode(raw[outside], kept[cuts])[:2]
        spot = offsets[np.searchsorted(cuts, begin)]
        before = np.searchsorted(begin, ends)  # added tokens before each row
        return np.insert(ids, spot, ids_of), offsets[np.searchsorted(cuts, ends)] + before

    def _added_in(self, raw: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(begin, end, id) of the added tokens in the rows."""
        if self.found is None:
            return []
        data = raw.tobytes()
        if not self.found.search(data):
            return []
        rows = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        return [(m.start(), m.end(), self.added[m.group()]) for a, b in rows for m in self.found.finditer(data, a, b)]


@cache
def tokenizer_of(path: str) -> LibraryTokenizer:
    """One tokenizer for each worker process."""
    return LibraryTokenizer(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each row with `end_id` appended, and the new offsets."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def tokenized(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, n_tokens, ids binary): ids with the end id, as little-endian unsigned integers of 2 bytes (4 if the vocabulary needs them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        kind = "<u2" if tokenizer.vocabulary <= 1 << 16 else "<u4"
        for batch in common.text_slices(batches, TOKENIZE_BYTES):
            ids, offsets = with_end(*tokenizer.encode(*common.text_bytes(batch.column(1))), end_id)
            blob, width = ids.astype(kind).tobytes(), int(kind[2])
            cuts = (offsets * width).tolist()
            values = pa.array([blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), values], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id stands in all rows; what comes to the driver is one number for each id of the vocabulary."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids, ends = common.text_bytes(batch.column(0).cast(pa.binary()))
            total += np.bincount(np.frombuffer(ids.tobytes(), kind), minlength=vocabulary)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    table = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[table["id"].to_numpy()] = table["n"].to_numpy()
    return out


#: Of each control byte: the lengths of its four codes.
LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)
MASKS = (np.uint64(1) << (np.arange(5, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    more = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = more
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4) <= more[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The `n` ranks of a block."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    until = np.cumsum(size)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    return (eight[until - size] & MASKS[size]).astype(np.uint32)


BLOCKS = "shard int, block int, n_tokens long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, out: str, end_id: int = 0) -> None:
    """Tokenises every text and writes the token files to the folder `out`: `blocks` and `ranks`."""
    vocabulary = tokenizer_of(path).vocabulary
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    tokens = common.staged(spark, tokenized(docs, path, end_id), "tokens")
    counts = id_counts(tokens, vocabulary)
    by_rank = np.lexsort((np.arange(vocabulary), -counts))  # bounded by the vocabulary
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[by_rank] = np.arange(vocabulary, dtype=np.uint32)
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(vocabulary)), "id": pa.array(by_rank)})).coalesce(1).write.parquet(f"{out}/ranks")
    ranks = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        ids, sizes, held, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            control, data = pack(ranks.value[np.frombuffer(b"".join(held), kind)])
            values = [[shard], [block], [total], [ids], [sizes], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["shard", "block", "n_tokens", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for doc_id, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                sizes.append(n)
                held.append(blob)
                total += n
                if total >= BLOCK_IDS:
                    yield flush()
                    block += 1
                    ids, sizes, held, total = [], [], [], 0
        if ids:
            yield flush()

    # by a hash of the ids too, so that many rows of one doc_id, or of none, are dealt over many ranges
    order = ("doc_id", "hash")
    ordered = tokens.withColumn("hash", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{out}/blocks")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """Reads token files back: (doc_id, start, n_tokens, ids binary of 4 bytes), `start` the number of ids before the document in all files."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    ranks = spark.read.parquet(f"{out}/ranks").orderBy("rank").toArrow()["id"].to_numpy().astype("<u4")  # bounded by the vocabulary
    ids_by_rank = spark.sparkContext.broadcast(ranks)
    # ids before each shard (one row for each shard) and before each block of a shard
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    within = Window.partitionBy("shard").orderBy("block")
    starts = blocks.select("shard", "block", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("inside")).join(shards, "shard")
    starts = starts.select("shard", "block", (F.col("before") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = np.array(lengths, np.int64)
                until = np.concatenate([[0], np.cumsum(sizes)])
                blob = ids_by_rank.value[unpack(control, data, int(until[-1]))].tobytes()
                cuts = (4 * until).tolist()
                values = [blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + until[:-1]), pa.array(sizes), pa.array(values, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(starts, ["shard", "block"]).select("start", "doc_ids", "lengths", "control", "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes the token files of `docs` into the shared folder and returns what is read back from them."""
    out = f"{common.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(spark, docs, path, out, end_id)
    return read_tokens(spark, out)
