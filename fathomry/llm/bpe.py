"""Byte-level BPE encoding and decoding.

`Ranks` holds a vocabulary of ranks; its `encode` cuts texts into pieces with the vectorised automaton of
`pretokenize` and merges each distinct piece once. `encode_documents` and `decode_documents` are the operators on
DataFrames; encoding keeps the byte offset of every piece, so a span of a text can be decoded alone.
Null texts count as empty, null ids as none. Repeated rows are encoded as often as they stand, whatever their doc_id; an
empty table gives an empty result. Extra columns are kept, whatever their names, but for those of the columns that are
added, which are replaced. Where pairs of equal rank stand in a piece, the leftmost is merged first.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import common, pretokenize

#: Bytes of text encoded at a time, and ids decoded at a time; workers of both hold no more than this and its tables.
ENCODE_BYTES, DECODE_IDS = 1 << 20, 1 << 18


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the neighbouring pair of lowest rank is merged first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 48:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank = ranks.get
    pairs = [rank(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at] += parts.pop(at + 1)
        pairs.pop(at)
        if at < len(pairs):
            pairs[at] = rank(parts[at] + parts[at + 1])
        if at:
            pairs[at - 1] = rank(parts[at - 1] + parts[at])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, for pieces of any length in n log n."""
    n = len(piece)
    end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop or end[i] >= stop:
            continue
        alive[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Ranks:
    """A vocabulary of merge ranks: lines of a token in base64 and its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = 1 + max(self.ranks.values())
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache = pretokenize.PieceCache(lambda pieces: [merge_pairs(p, self.ranks) for p in pieces])

    def encode(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts laid end to end: (ids, offsets of the rows' ids, byte offsets of the pieces, ids of each piece)."""
        return self.cache.encode(raw, ends)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, the n + 1 byte offsets of the ids), by table look-up."""
        length = self.length[ids]
        until = np.concatenate([[0], np.cumsum(length)])
        return self.bytes[np.arange(until[-1]) + np.repeat(self.begin[ids] - until[:-1], length)], until


@cache
def ranks_of(path: str) -> Ranks:
    """One vocabulary for each worker process, its merged pieces kept between tasks."""
    return Ranks(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Adds to each row its `ids` array<int>, and for each piece of its text `piece_start` (byte offset) and `piece_ids` (number of ids)."""
    docs = docs.drop("ids", "piece_start", "piece_ids")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, ENCODE_BYTES):
            raw, ends = common.text_bytes(batch.column(names.index("text")))
            ids, offsets, starts, count = ranks_of(path).encode(raw, ends)
            first = np.searchsorted(starts, ends)
            within = starts - np.repeat(ends[:-1], np.diff(first))
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int32())) for o, v in ((offsets, ids), (first, within), (first, count))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*names, "ids", "piece_start", "piece_ids"])

    return docs.mapInArrow(run, StructType([*docs.schema, *(StructField(c, ArrayType(IntegerType())) for c in ("ids", "piece_start", "piece_ids"))]))


def id_slices(batches: Iterator[pa.RecordBatch], at: int, limit: int = DECODE_IDS) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose lists in column `at` hold about `limit` ids (a longer list stands alone)."""
    for batch in batches:
        ends = np.cumsum(batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        row, before = 0, 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(row, to - row)
            row, before = to, int(ends[to - 1])
            common.trim()


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Replaces `ids` by `decoded` binary: the very bytes that were encoded (null ids: empty)."""
    names = [c for c in encoded.columns if c not in ("ids", "decoded")]
    encoded = encoded.select(*[encoded[f"`{c}`"] for c in names], "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in id_slices(batches, len(names)):
            column = batch.column(len(names))
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out, until = ranks_of(path).decode(column.flatten().to_numpy(zero_copy_only=False))
            cuts = until[np.concatenate([[0], np.cumsum(size)])]
            blob = out.tobytes()
            values = pa.array([blob[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*(f for f in encoded.schema if f.name != "ids"), StructField("decoded", BinaryType())]))
