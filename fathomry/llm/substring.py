"""Substring dedup with a log-structured fingerprint index.

The index is a folder of immutable runs. A run holds the fingerprints of the windows (WIDTH consecutive words) that one
batch of documents added, cut into buckets by their high bits and sorted within each. All runs are partitions of one
table bucketed by that number, so that merging a new batch with old runs moves only the new batch. For every batch

1. tasks fingerprint their windows, settle repeats among their own documents, and send one document's windows for each
   fingerprint, sorted (a passage in a third of all documents becomes one entry a task);
2. buckets merge-join what was sent with each other and with all runs. A match is verified: the windows must also agree
   in a check. Fingerprint and check come from independent halves of keyed digests of the window's words, 96 bits
   together, and the key is secret, so that texts can't be written to collide. What an earlier document or run has is
   marked, what is new becomes the next run. Marked windows stay in the bucket that found them, in one file, and are
   dealt to their documents when they are read;
3. when there are more than `max_runs` runs, they are merged into one and the old ones are emptied.

The folder tells which runs count (a manifest, written after a run is complete), so an index can be opened again in
another session and go on with the next batch. `dedup` takes ascending ranges of doc_id as batches, so runs always
belong to smaller ids. Windows are judged on the input, never on what is left.

Size: a bucket holds about BUCKET windows of a batch; there are at most 2**MOST_BITS buckets, in at most MOST_FILES
files a run, and beyond that size there are more batches.

Texts: null counts as no words; texts of fewer than WIDTH words have no window and stay whole. Windows of rows that
share a doc_id don't count against each other (repeated rows all keep their words); a row with a null doc_id is neither
marked nor indexed. An empty table gives an empty result. Extra columns are kept, whatever their names, but for those of
the columns that are added, which are replaced.
"""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

WIDTH = 13
#: Windows that a task holds before it sends them, and windows in a bucket of one batch, on average.
HELD, BUCKET = 1 << 20, 1 << 18
#: Bounds of the number of buckets, and of the files of a run; windows that a task holds at most, so that rows stay filled.
MOST_BITS, MOST_FILES, MOST_HELD = 18, 1 << 15, 1 << 22

SENT = "bucket int, n long, hashes binary, checks binary, doc_ids binary, rows binary, doc_of binary, at binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), *((c, pa.binary()) for c in ("hashes", "checks", "doc_ids", "rows", "doc_of", "at"))])
#: kind 0: marked windows that one bucket found or was sent, packed as they are sent. kind 1: a bucket's new fingerprints.
KEPT = f"{SENT}, kind int"
_KEPT_ARROW = _SENT_ARROW.append(pa.field("kind", pa.int32()))
#: Marked windows on their way to their documents, packed as they are sent.
_DEALT_ARROW = pa.schema([("doc_group", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "rows", "doc_of", "at"))])


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each in a process, as rows are many and short."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def shrink(values: np.ndarray) -> bytes:
    """An integer array as bytes: its byte planes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return _zstd()[0].compress(planes)


def grow(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_zstd()[1].decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def shrink_sorted(values: np.ndarray) -> bytes:
    return shrink(np.diff(values, prepend=values.dtype.type(0)))


def grow_sorted(blob: bytes, kind: str) -> np.ndarray:
    return np.cumsum(grow(blob, kind), dtype=kind)


class _Windows:
    """Windows of a task, held until there are enough to be sent."""

    def __init__(self, width: int, bits: int, key: bytes):
        self.width, self.bits, self.digests = width, bits, common.digests_of(key)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.checks, self.doc, self.at, self.ids, self.rows, self.held, self.docs = [], [], [], [], [], [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        raw, ends = common.text_bytes(batch.column(1))
        starts, stops, bounds = common.word_spans(raw, ends)
        words = self.digests.of(raw, starts, stops)
        first, hashes = common.window_hashes(np.ascontiguousarray(words[:, 0]), bounds, self.width)
        _, checks = common.window_hashes(np.ascontiguousarray(words[:, 1]), bounds, self.width)
        doc = np.searchsorted(bounds, first, "right") - 1
        self.hashes.append(hashes)
        self.checks.append((checks >> np.uint64(32)).astype("<u4"))
        self.doc.append((doc + self.docs).astype(np.int32))
        self.at.append((first - bounds[doc]).astype(np.uint32))
        self.ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        self.rows.append(batch.column(2).to_numpy(zero_copy_only=False))
        self.held += len(first)
        self.docs += batch.num_rows

    def send(self, salt: int) -> Iterator[pa.RecordBatch]:
        """One row for each bucket that has windows, and one with the windows marked here."""
        hashes, checks, doc, at = (np.concatenate(x) for x in (self.hashes, self.checks, self.doc, self.at))
        ids, rows = np.concatenate(self.ids).astype(np.int64), np.concatenate(self.rows).astype("<i8")
        self.clear()
        if not len(hashes):
            return
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
        order = np.lexsort((checks, hashes))
        hashes, checks, doc, at = hashes[order], checks[order], doc[order], at[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])])
        lead = np.flatnonzero(new)
        low = np.minimum.reduceat(rank[doc], lead)
        first = rank[doc] == np.repeat(low, np.diff(np.append(lead, len(hashes))))

        def row(bucket: int, chosen: np.ndarray | slice, with_hashes: bool) -> list:
            h, c = (hashes[chosen], checks[chosen]) if with_hashes else (hashes[:0], checks[:0])
            return [bucket, len(at[chosen]), shrink_sorted(h), shrink(c), *_packed(ids, rows, doc[chosen], at[chosen])]

        out = []
        marked = np.flatnonzero(~first)
        if len(marked):
            out.append(row(salt & ((1 << self.bits) - 1), marked[np.lexsort((at[marked], doc[marked]))], False))
        hashes, checks, doc, at = hashes[first], checks[first], doc[first], at[first]
        where = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
        out += [row(int(where[a]), slice(a, b), True) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SENT_ARROW, strict=True)], schema=_SENT_ARROW).to_batches(64)


def _packed(ids: np.ndarray, rows: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Windows as they are sent: `doc_ids` and `rows` of their documents, `doc_of` and `at` of each; `doc` is a window's place in `ids` and `rows`."""
    used, doc_of = np.unique(doc, return_inverse=True)
    by_id = np.argsort(ids[used], kind="stable")
    place = np.empty(len(used), np.uint32)
    place[by_id] = np.arange(len(used), dtype=np.uint32)
    used = used[by_id]
    return [shrink_sorted(ids[used]), shrink(rows[used]), shrink(place[doc_of]), shrink(at)]


def _by_document(packed: Iterable[tuple[bytes, bytes, bytes, bytes]], groups: int = 1) -> tuple[np.ndarray, ...]:
    """Windows of packed rows by group and document: (group, id and row of each document, the n + 1 offsets of its windows, `at` of the windows, ascending)."""
    ids, rows, doc, at, n = [], [], [], [], 0
    for i, r, d, a in packed:
        ids.append(grow_sorted(i, "<i8"))
        rows.append(grow(r, "<i8"))
        doc.append(grow(d, "<u4").astype(np.int64) + n)
        at.append(grow(a, "<u4"))
        n += len(ids[-1])
    ids, rows, doc, at = (np.concatenate(x) for x in (ids, rows, doc, at))
    group = (common.mix64(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((rows, ids, group))
    group, ids, rows = group[order], ids[order], rows[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])])[:n]
    place = np.empty(n, np.uint64)
    place[order] = np.cumsum(new) - 1
    doc = place[doc]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc.astype(np.int64), minlength=int(new.sum())))])
    at = np.sort(doc << np.uint64(32) | at).astype("<u4")  # the lower half
    return group[new], ids[new], rows[new], offsets, at


def _deal(packed: list[tuple[bytes, bytes, bytes, bytes]], groups: int) -> Iterator[pa.RecordBatch]:
    """A row for each group of documents that has windows in packed rows."""
    group, ids, rows, offsets, at = _by_document(packed, groups)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])).tolist()
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        doc_of = np.repeat(np.arange(b - a, dtype=np.uint32), np.diff(offsets[a : b + 1]))
        out.append([int(group[a]), shrink_sorted(ids[a:b]), shrink(rows[a:b]), shrink(doc_of), shrink(at[offsets[a] : offsets[b]])])
    yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DEALT_ARROW, strict=True)], schema=_DEALT_ARROW).to_batches(64)


def _unpack_marked(group: pa.Table) -> pa.Table:
    """A row for each document of a group: its marked windows from all buckets."""
    common.trim()
    _, ids, rows, offsets, at = _by_document(zip(*(group[c].to_pylist() for c in ("doc_ids", "rows", "doc_of", "at")), strict=True))
    blob, cuts = at.tobytes(), (4 * offsets).tolist()
    values = [blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"doc_id": ids, "row": rows, "at": pa.array(values, pa.binary())})


def _merge(key: tuple, sent: pa.Table, runs: pa.Table) -> pa.Table:
    """Merge-joins what a batch sent to one bucket with itself and with the bucket's part of every run.

    All rows that come out are the bucket's, so that a bucket writes one file of marked windows and one of fingerprints.
    """
    common.trim()
    bucket, out = key[0].as_py(), []
    hashes, checks, ids, rows, doc, at, docs = [], [], [], [], [], [], 0
    for n, h, c, i, r, d, a in zip(*(sent[x].to_pylist() for x in sent.column_names[1:]), strict=True):
        if len(got := grow_sorted(h, "<u8")):
            hashes.append(got)
            checks.append(grow(c, "<u4"))
            ids.append(grow_sorted(i, "<i8"))
            rows.append(grow(r, "<i8"))
            doc.append(grow(d, "<u4").astype(np.int32) + np.int32(docs))
            at.append(grow(a, "<u4"))
            docs += len(ids[-1])
        elif n:
            out.append([bucket, n, None, None, i, r, d, a, 0])
    if hashes:
        hashes, checks, ids, rows, doc, at = (np.concatenate(x) for x in (hashes, checks, ids, rows, doc, at))
        order = np.lexsort((checks, hashes))
        hashes, checks, doc, at = hashes[order], checks[order], doc[order], at[order]
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)[doc]
        lead = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])]))
        size = np.diff(np.append(lead, len(hashes)))
        own, own_check = hashes[lead], checks[lead]
        known = np.zeros(len(own), bool)
        for h, c in zip(runs["hashes"].to_pylist(), runs["checks"].to_pylist(), strict=True):
            old, old_check = grow_sorted(h, "<u8"), grow(c, "<u4")
            # both are sorted; a fingerprint stands twice only with another check
            spot = np.searchsorted(old, own)
            live = np.arange(len(own))
            while len(live):
                live = live[spot[live] < len(old)]
                live = live[old[spot[live]] == own[live]]
                same = old_check[spot[live]] == own_check[live]
                known[live[same]] = True
                live = live[~same]
                spot[live] += 1
        marked = np.repeat(known, size) | (rank > np.repeat(np.minimum.reduceat(rank, lead), size))
        if marked.any():
            out.append([bucket, int(marked.sum()), None, None, *_packed(ids, rows, doc[marked], at[marked]), 0])
        out.append([bucket, int((~known).sum()), shrink_sorted(own[~known]), shrink(own_check[~known]), None, None, None, None, 1])
    return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_KEPT_ARROW)], schema=_KEPT_ARROW)


def _compact(group: pa.Table) -> pa.Table:
    """The parts of all runs in one bucket as one sorted part."""
    hashes = np.concatenate([grow_sorted(h, "<u8") for h in group["hashes"].to_pylist()])
    checks = np.concatenate([grow(c, "<u4") for c in group["checks"].to_pylist()])
    order = np.lexsort((checks, hashes))
    hashes, checks = hashes[order], checks[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])])[: len(hashes)]
    common.trim()
    return pa.table({"bucket": [group["bucket"][0].as_py()], "n": [int(new.sum())], "hashes": [shrink_sorted(hashes[new])], "checks": [shrink(checks[new])], "doc_ids": [None], "rows": [None], "doc_of": [None], "at": [None], "kind": [1]}, schema=_KEPT_ARROW)


class FingerprintIndex:
    """An index in the folder `path`, made with `create` and opened again with `open`."""

    def __init__(self, spark: SparkSession, path: str, bits: int, width: int, key: bytes, max_runs: int, files: int):
        self.spark, self.path, self.bits, self.width, self.key, self.max_runs = spark, path, bits, width, key, max_runs
        self.table = f"substring_{uuid.uuid4().hex}"
        place = f"{path}/runs".replace("'", "\\'")
        spark.sql(f"create table {self.table} ({KEPT}, run int) using parquet partitioned by (kind, run) clustered by (bucket) into {files} buckets location '{place}'")
        self.version, self.runs, self.batches = 0, [], []

    @classmethod
    def create(cls, spark: SparkSession, path: str, bits: int, width: int = WIDTH, max_runs: int = 4) -> FingerprintIndex:
        """A new index of 2**bits buckets."""
        if not 0 <= bits <= MOST_BITS:
            raise ValueError(f"bits are 0 to {MOST_BITS}")
        # no fewer files than a shuffle has partitions, so that a batch is shuffled to them and never they to it
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << bits, MOST_FILES))
        values = [(bits, width, bytearray(secrets.token_bytes(32)), max_runs, files)]
        spark.createDataFrame(values, "bits int, width int, key binary, max_runs int, files int").coalesce(1).write.parquet(f"{path}/settings")
        cls._manifest(spark, path, 0, [], [])
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index in a folder, with the runs of its latest manifest."""
        r = spark.read.parquet(f"{path}/settings").first()
        index = cls(spark, path, r["bits"], r["width"], bytes(r["key"]), r["max_runs"], r["files"])
        told = spark.read.parquet(f"{path}/manifest-*").orderBy(F.desc("version")).first()
        index.version, index.runs, index.batches = told["version"], list(told["runs"]), list(told["batches"])
        if index.batches:
            spark.sql(f"alter table {index.table} recover partitions")
        return index

    def _tell(self) -> None:
        """Writes which runs count from now on."""
        self.version += 1
        self._manifest(self.spark, self.path, self.version, self.runs, self.batches)

    @staticmethod
    def _manifest(spark: SparkSession, path: str, version: int, runs: list[int], batches: list[int]) -> None:
        row = spark.createDataFrame([(version, runs, batches)], "version int, runs array<int>, batches array<int>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest-{version}")

    def _empty(self, kind: int, run: int) -> None:
        nothing = ", ".join(f"cast(null as {c.split()[1]})" for c in KEPT.split(", ")[:-1])
        self.spark.sql(f"insert overwrite table {self.table} partition (kind = {kind}, run = {run}) select {nothing} where false")

    def _save(self, df: DataFrame) -> int:
        run = secrets.randbits(31)  # never that of a run that broke off and left files
        df.withColumn("run", F.lit(run)).write.insertInto(self.table)
        return run

    def _part(self, kind: int, runs: list[int]) -> DataFrame:
        return self.spark.table(self.table).where((F.col("kind") == kind) & F.col("run").isin(runs))

    def add(self, docs: DataFrame, compact: bool = True) -> None:
        """Merges a batch (doc_id, text, row long), whose documents count as later than all before, and marks its known windows."""
        width, bits, key = self.width, self.bits, self.key
        limit = min(max(HELD, 64 << bits), MOST_HELD)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows, salt = _Windows(width, bits, key), TaskContext.get().partitionId()
            for batch in common.text_slices(batches):
                windows.add(batch)
                if windows.held >= limit:
                    yield from windows.send(salt)
                    salt += 1
            if windows.docs:
                yield from windows.send(salt)

        sent = docs.select("doc_id", "text", "row").mapInArrow(send, SENT)
        known = self._part(1, self.runs).select("bucket", "hashes", "checks")
        merged = sent.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_merge, KEPT)
        run = self._save(merged)
        self.runs.append(run)
        self.batches.append(run)
        self._tell()
        if compact and len(self.runs) > self.max_runs:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one."""
        old = self.runs
        self.runs = [self._save(self._part(1, old).select(*_KEPT_ARROW.names).groupBy("bucket").applyInArrow(_compact, KEPT))]
        self._tell()
        for run in old:  # the marks of its batch stay
            self._empty(1, run)

    def marked(self, batches: list[int] | None = None) -> DataFrame:
        """(doc_id, row, at) of batches (all, if none are named), once for each document: the first words of its marked windows."""
        part = self._part(0, self.batches if batches is None else batches)
        groups = 1 + (part.agg(F.sum("n")).first()[0] or 0) // BUCKET
        limit = HELD

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                for more, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append(packed)
                    n += more
                    if n >= limit:
                        yield from _deal(held, groups)
                        held, n = [], 0
            if held:
                yield from _deal(held, groups)

        dealt = part.select("n", "doc_ids", "rows", "doc_of", "at").mapInArrow(deal, "doc_group long, doc_ids binary, rows binary, doc_of binary, at binary")
        return dealt.groupBy("doc_group").applyInArrow(_unpack_marked, "doc_id long, row long, at binary")

    def close(self) -> None:
        """Forgets the table's name; the folder stays."""
        self.spark.sql(f"drop table if exists {self.table}")

    def drop(self) -> None:
        """Closes the index and empties its folder."""
        self.close()
        self.spark.range(0).write.mode("overwrite").parquet(self.path)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row) of the rows with a doc_id; row tells the texts of rows that share a doc_id apart."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))


def mark(spark: SparkSession, docs: DataFrame, width: int = WIDTH, batches: int = 4, max_runs: int = 2) -> DataFrame:
    """(doc_id, row, at binary): for each document the first words of its windows that a smaller doc_id has too, staged.

    batches: how many ranges of doc_id at least.
    """
    docs = keyed(docs)
    # six bytes a word is near enough to size the buckets
    words = (docs.select(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    batches = max(batches, int(words / (BUCKET << (MOST_BITS + 2))))
    bits = min(MOST_BITS, int(words / batches / BUCKET).bit_length())
    cuts = [i / batches for i in range(1, batches)]
    edges = sorted(set(docs.select(F.percentile_approx("doc_id", cuts)).first()[0] or [])) if cuts else []
    index = FingerprintIndex.create(spark, f"{common.shared_dir(spark)}/index-{uuid.uuid4().hex}", bits, width, max_runs)
    try:
        for low, high in zip([None, *edges], [*edges, None], strict=True):
            part = docs
            if low is not None:
                part = part.where(F.col("doc_id") > low)
            if high is not None:
                part = part.where(F.col("doc_id") <= high)
            index.add(part, compact=False)
            common.release_shuffles(spark)
            if high is not None and len(index.runs) > max_runs:  # nothing comes after the last; what the batch shuffled is gone by now
                index.compact()
                common.release_shuffles(spark)
        return common.staged(spark, index.marked(), "marked")
    finally:
        index.drop()


def _strip(text: bytes | None, at: bytes | None, width: int, layout: bool) -> tuple[int, int, bytes]:
    """(words, words removed, what is kept: words joined by one space, or with `layout` the text without the words removed and the blanks after them)."""
    raw = np.frombuffer(text or b"", np.uint8)
    starts, stops, _ = common.word_spans(raw, np.array([0, len(raw)]))
    n = len(starts)
    keep = ~common.covered(np.frombuffer(at, "<u4").astype(np.int64), n, width) if at else np.ones(n, bool)
    removed = int(n - keep.sum())
    if not layout:
        return n, removed, b" ".join([text[i:j] for i, j in zip(starts[keep].tolist(), stops[keep].tolist(), strict=True)])
    if not removed:
        return n, 0, text or b""
    until = np.append(starts[1:], len(raw))
    edge = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=0, append=0))
    kept = b"".join([text[starts[a] : until[b - 1]] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
    return n, removed, text[: starts[0]] + (kept if keep[-1] else kept.rstrip(b" \t\n\x0b\x0c\r"))


def cut(spark: SparkSession, docs: DataFrame, width: int = WIDTH, batches: int = 4, layout: bool = False) -> DataFrame:
    """(row, n_words, n_removed, kept) of all rows of `docs`; `row` has their columns. See `dedup`."""
    marks = mark(spark, docs, width, batches).select(F.col("doc_id").alias("id"), F.col("row").alias("hash"), "at").hint("shuffle_hash")
    rows = common.packed(docs).withColumns({"doc_id": F.col("row.doc_id").cast("long"), "text_hash": F.xxhash64("row.text")})
    joined = rows.join(marks, (F.col("doc_id") == F.col("id")) & (F.col("text_hash") == F.col("hash")), "left").select("row", "at")
    text = common.field_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, text=text):
            column = text(batch)
            texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
            got = [_strip(t, a, width, layout) for t, a in zip(texts, batch.column(1).to_pylist(), strict=True)]
            n, removed, kept = zip(*got, strict=True) if got else ((), (), ())
            more = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["row", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, StructType([StructField("row", docs.schema), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]))


def dedup(spark: SparkSession, docs: DataFrame, width: int = WIDTH, batches: int = 4, layout: bool = False) -> DataFrame:
    """All rows of `docs` with `n_words`, `n_removed` and `kept` added.

    kept: the kept words joined by one space; with `layout` the text itself without the words removed and the blanks
    after them (a text that loses nothing is kept as it stands).
    """
    return cut(spark, docs.drop("n_words", "n_removed", "kept"), width, batches, layout).select("row.*", "n_words", "n_removed", "kept")
