"""Shared helpers of the training-data operators: staging, text batches, word spans, components."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised pass of a Python worker holds at a time.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may leave it unset and gets one of its own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="staging-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet into the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Empties the folders of staged frames that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            df.sparkSession.range(0).write.mode("overwrite").parquet(folder)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@cache
def _malloc_trim():
    """glibc's malloc_trim, or nothing where the C library has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def trim() -> None:
    """Gives freed memory of this worker back to the system, so that workers of one executor share what there is."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES, text: Callable[[pa.RecordBatch], pa.Array] | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose texts (column `text`, or what `text` takes from a batch) hold about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = text(batch) if text else batch.column(batch.schema.get_field_index("text"))
        width = "<i8" if pa.types.is_large_string(column.type) else "<i4"
        ends = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + batch.num_rows + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
            trim()


def packed(docs: DataFrame) -> DataFrame:
    """All columns of `docs` as one, `row`: the caller's names then meet no others, and `row.*` gives them back."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def field_of(docs: DataFrame, name: str) -> Callable[[pa.RecordBatch], pa.Array]:
    """Takes a column of `docs` from a batch whose first column is the `row` of `packed`."""
    at = docs.columns.index(name)
    return lambda batch: batch.column(0).field(at)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the n + 1 offsets of its rows (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    width = "<i8" if pa.types.is_large_string(column.type) else "<i4"
    ends = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


#: Fixed by the contracts: the bytes that separate words, \x20 and \x09-\x0D.
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` in bytes, and the n + 1 offsets of each row's words."""
    inside = ~_IS_BLANK[raw]
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
        cuts = ends[:-1][ends[:-1] < len(raw)]
        before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    # a word ends where the next byte is blank, or belongs to the next row
    last = inside.copy()
    if len(raw):
        last[:-1] &= ~(inside[1:] & before[1:])
    stops = np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (xor-shift multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Digests:
    """Two independent 64-bit numbers for each word, by multilinear hashing under a secret key.

    A lane is the upper half of the sum of a word's 32-bit parts, and its length, each times a secret 64-bit number of
    the lane's own; two lanes make a number, which is then mixed. Any two words agree in one number with a chance of
    2**-64, and as whoever writes a text doesn't know the key, no words can be made to agree.
    """

    LANES = 4

    def __init__(self, key: bytes):
        self.key, self.drawn = key, 0
        self.secret = np.empty((0, self.LANES), np.uint64)
        self._draw(64)

    def _draw(self, n: int) -> None:
        """At least `n` rows of secret numbers: digests of a counter under the key."""
        while len(self.secret) < n:
            more = b"".join(hashlib.blake2b((self.drawn + i).to_bytes(8, "little"), key=self.key).digest() for i in range(max(32, len(self.secret) // 2)))
            self.drawn += max(32, len(self.secret) // 2)
            self.secret = np.concatenate([self.secret, np.frombuffer(more, "<u8").reshape(-1, self.LANES)])

    def of(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """[n, 2] of the words from `starts` to `stops` in bytes."""
        size = stops - starts
        self._draw(4 + 2 * -(-int(size.max(initial=0)) // 8))
        padded = np.zeros(len(raw) + 8, np.uint8)
        padded[: len(raw)] = raw
        eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
        sums = [self.secret[0, x] + size.astype(np.uint64) * self.secret[1, x] for x in range(self.LANES)]
        live, at, left, step = slice(None), starts, size, 2
        while len(at):
            part = eight[at]
            short = left < 8
            part = np.where(short, part & ((np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) << np.uint64(3))) - np.uint64(1)), part)
            low, high = part & np.uint64(0xFFFFFFFF), part >> np.uint64(32)
            for x in range(self.LANES):
                sums[x][live] += low * self.secret[step, x] + high * self.secret[step + 1, x]
            more = np.flatnonzero(left > 8)
            live = more if isinstance(live, slice) else live[more]
            at, left, step = at[more] + 8, left[more] - 8, step + 2
        upper = np.uint64(0xFFFFFFFF00000000)
        return np.stack([mix64((sums[x] & upper | sums[x + 1] >> np.uint64(32)) ^ self.secret[0, x]) for x in (0, 2)], axis=1)


@lru_cache(maxsize=2)
def digests_of(key: bytes) -> Digests:
    """One set of secret numbers for each key in a worker process."""
    return Digests(key)


def window_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of `n` consecutive words of one row: (index of the first word, hash)."""
    total = len(words) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.zeros(total, np.uint64)
    for j in range(n):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += words[j : j + total]
    count = np.diff(bounds)
    row_end = np.repeat(bounds[1:], count)
    first = np.flatnonzero(np.arange(total) + n <= row_end[:total])
    return first, mix64(acc[first])


def covered(first: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Which of `n_words` words lie in a window of `width` words that begins at one of `first`."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + width, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


#: A node with more edges than this, and than a 50,000th of all edges, is a hub: there are at most 50,000 hubs.
HUB, HUBS = 1000, 50_000


def _with_lowest(edges: DataFrame, low: DataFrame, bound: int) -> DataFrame:
    """Edges (a, b) with `m`, what `low` (a, m, n) says of a; edges of hubs meet it without a shuffle, so that none gathers in one task."""
    hubs = F.broadcast(low.where(F.col("n") > bound).select("a", "m"))  # at most HUBS rows, or all edges / HUB
    tagged = edges.join(hubs, "a", "left")
    rest = tagged.where("m is null").select("a", "b").join(low.where(F.col("n") <= bound).select("a", "m"), "a")
    return tagged.where("m is not null").select("a", "b", "m").union(rest.select("a", "b", "m"))


def join_hot(rows: DataFrame, told: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` (`total` of them) with what `told` says of their `key`: one row for each, with `n`, the number of rows that have it.

    Keys of many rows are broadcast, so that a key with a third of all rows stays where its rows are.
    """
    bound = max(HUB, total // HUBS)
    names = [c for c in told.columns if c not in (key, "n")]
    part = lambda where: told.where(where).select(key, F.struct(*names).alias("told"))
    tagged = rows.join(F.broadcast(part(F.col("n") > bound)), key, "left")  # at most HUBS rows
    rest = tagged.where("told is null").select(*rows.columns).join(part(F.col("n") <= bound), key)
    out = [*rows.columns, "told.*"]
    return tagged.where("told is not null").select(*out).union(rest.select(*out))


def components(spark: SparkSession, links: DataFrame, label: str) -> DataFrame:
    """Connected components of `links` (a, b of one type that has an order): (id, root), root the smallest id reachable.

    Alternates large-star and small-star contractions on DataFrames. A node's neighbours are reduced by an aggregate and
    rejoined, never gathered. Each round is staged in the shared folder, the one before is emptied. The number of
    rounds grows with the logarithm of the longest path. Nodes without a link don't appear.
    """
    edges = staged(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    bound = max(HUB, 2 * edges.count() // HUBS)
    while True:
        # large star: every neighbour above u is hung onto the smallest of u's neighbourhood
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        grown = staged(spark, _with_lowest(both.where("b > a"), low, bound).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label)
        # small star: u and its lower neighbours are hung onto the smallest of them
        low = grown.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        shrunk = _with_lowest(grown, low, bound).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = staged(spark, shrunk.where("a <> b").distinct(), label)
        discard(edges, grown)
        # done when every node has one parent and no parent has a parent of its own
        heads = after.groupBy("a").agg(F.count("*").alias("n"))
        if heads.where("n > 1").isEmpty() and after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            return after.select(F.col("a").alias("id"), F.col("b").alias("root"))
        edges = after


#: Stands for a null id where ids are ordered, so that nulls come last.
NO_ID = (1 << 63) - 1
