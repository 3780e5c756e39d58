"""Best-fit packing of documents into sequences of at most `limit` tokens, by linear grouping.

Only documents above the limit are cut; the first piece takes the remainder. The plan is made from the histogram of
piece lengths, which has at most `limit` entries however large the corpus is:

1. Lengths above limit / SMALL are large. In descending order they are split into groups of equal cardinality, and
   each is rounded up to the largest of its group.
2. Configurations (how many of each rounded length share a sequence) are optimised by column generation: a linear
   programme over the few rounded lengths, new configurations from a knapsack over the limit.
3. Configurations are filled with the actual lengths of each group; what rounding left over becomes free room.
4. What remains, large leftovers first and then the small lengths, goes to the tightest sequence it fits.

A plan is a table of runs: pieces of one length with ranks a to b go to consecutive sequences at one offset. Pieces
get their rank by counting, and find their run by a join, so no piece ever comes to the driver.

Null texts are empty (one end token). Repeated rows are packed as often as they stand. An empty table packs to
nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, token_io

#: Lengths of at most limit / SMALL tokens are small.
SMALL = 8
#: Groups of equal cardinality.
GROUPS = 48

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document with their place, length and CRC, and (part, nth): the piece's number among those of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in common.text_slices(batches, token_io.TOKENIZE_BYTES):
            ids, offsets = token_io.with_end(*token_io.tokenizer_of(path).encode(*common.text_bytes(batch.column(1))), end_id)
            size = np.diff(offsets)
            count = -(-size // limit)
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = (size - 1) % limit + 1
            length = np.where(piece == 0, head[row], limit)
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * limit)
            blob = ids.astype("<u4").tobytes()
            a = (offsets[:-1][row] + start) * 4
            crc = [zlib.crc32(blob[i:j]) for i, j in zip(a.tolist(), (a + 4 * length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            runs = length[order]
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.searchsorted(runs, runs) + seen[runs]
            seen += np.bincount(length, minlength=limit + 1)
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{PIECES}, part int, nth long")


def _configurations(sizes: list[int], demand: list[int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(how many of each size, how often) covering at most the demand: column generation, rounded down.

    Each round prices sizes by the dual of the current basis and looks for a better configuration with a knapsack
    over the limit; it ends when none is better.
    """
    k = len(sizes)
    need = np.array(demand, float)
    base = np.diag([limit // s for s in sizes]).astype(float)
    for _ in range(60 * k):
        price = np.linalg.solve(base.T, np.ones(k))
        best = np.zeros(limit + 1)  # knapsack without bounds: value of each capacity, and the size taken last
        take = np.full(limit + 1, -1)
        for c in range(sizes[-1], limit + 1):
            fits = [i for i in range(k) if sizes[i] <= c] if c < sizes[0] else range(k)
            at = np.fromiter(fits, np.int64)
            value = best[c - np.array(sizes)[at]] + price[at]
            i = int(np.argmax(value))
            if value[i] > best[c - 1] + 1e-12:
                best[c], take[c] = value[i], at[i]
            else:
                best[c], take[c] = best[c - 1], -1
        if best[limit] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), limit
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                column[take[c]] += 1
                c -= sizes[take[c]]
        level, direction = np.linalg.solve(base, need), np.linalg.solve(base, column)
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        base[:, int(np.argmin(ratio))] = column
    often = np.floor(np.linalg.solve(base, need) + 1e-7).astype(np.int64)
    return [(tuple(int(x) for x in base[:, j]), int(n)) for j, n in enumerate(often) if n > 0]


class Plan:
    """Runs of sequences that hold the same lengths at the same offsets."""

    def __init__(self, limit: int):
        self.limit, self.sequences = limit, 0
        self.given: Counter = Counter()  # pieces of each length that have a place
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, number of pieces, first sequence, offset
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: (first sequence, number of sequences)
        self.rooms: list[int] = []

    def open(self, n: int) -> int:
        """`n` new sequences."""
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def free(self, first: int, n: int, room: int) -> None:
        if room:
            if not self.room[room]:
                insort(self.rooms, room)
            self.room[room].append((first, n))

    def place(self, length: int, first: int, n: int, offset: int) -> None:
        """One piece of `length` in each of `n` sequences."""
        self.runs.append((length, self.given[length], n, first, offset))
        self.given[length] += n

    def best_fit(self, length: int, count: int) -> None:
        """`count` pieces, each into the fullest sequence that still takes it, else into a new one."""
        while count:
            i = bisect_left(self.rooms, length)
            if i < len(self.rooms):
                room = self.rooms[i]
                first, n = self.room[room].pop()
                if not self.room[room]:
                    self.rooms.pop(i)
            else:
                room, n = self.limit, max(1, count // (self.limit // length))
                first = self.open(n)
            each = min(room // length, count)
            used = min(n, count // each)
            if used < n:
                self.free(first + used, n - used, room)
            for k in range(each):
                self.place(length, first, used, self.limit - room + k * length)
            self.free(first, used, room - each * length)
            count -= each * used


def plan(histogram: dict[int, int], limit: int) -> Plan:
    """Packs `histogram` (number of pieces of each length of 1 to `limit`)."""
    out = Plan(limit)
    left = Counter(histogram)
    large = sorted((n for n in left if n * SMALL > limit), reverse=True)
    total = sum(left[n] for n in large)
    groups: list[list[list[int]]] = []  # of each group: [length, pieces], descending
    share, room = -(-total // GROUPS), 0
    for n in large:
        count = left[n]
        while count:
            if not room:
                groups.append([])
                room = share
            got = min(room, count)
            groups[-1].append([n, got])
            count -= got
            room -= got
    if groups:
        merged: dict[int, list[list[int]]] = {}
        for g in groups:  # groups that round to the same length are one
            merged.setdefault(g[0][0], []).extend(g)
        sizes = sorted(merged, reverse=True)
        queue = {s: merged[s] for s in sizes}
        for config, often in _configurations(sizes, [sum(n for _, n in queue[s]) for s in sizes], limit):
            slots = [s for s, n in zip(sizes, config, strict=True) for _ in range(n)]
            while often and all(queue[s] for s in slots):
                # actual lengths for the slots, and how many sequences can take the same ones
                taken, uses = [], Counter()
                for s in slots:
                    spot = 0
                    while spot < len(queue[s]) and uses[s, spot] >= queue[s][spot][1]:
                        spot += 1
                    if spot == len(queue[s]):
                        break
                    uses[s, spot] += 1
                    taken.append(queue[s][spot][0])
                if len(taken) < len(slots):
                    break
                n = min([often, *(queue[s][spot][1] // u for (s, spot), u in uses.items())])
                first, at = out.open(n), 0
                for length in taken:
                    out.place(length, first, n, at)
                    at += length
                for (s, spot), u in uses.items():
                    queue[s][spot][1] -= n * u
                for s in set(slots):
                    queue[s] = [x for x in queue[s] if x[1]]
                out.free(first, n, limit - at)
                often -= n
    for n in sorted(left, reverse=True):
        out.best_fit(n, left[n] - out.given[n])
    return out


def pack(spark: SparkSession, pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """Adds `sequence_id` and `offset` to staged pieces (length, part, nth and any other columns)."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    runs = plan(histogram, limit).runs
    # ranks are cut at fixed strides, so that a piece meets its run by an equality and a look into few runs
    stride = {n: max(1, -(-c // 64)) for n, c in histogram.items()}
    cells = [(n, b, a, a + count, first, offset) for n, a, count, first, offset in runs for b in range(a // stride[n], (a + count - 1) // stride[n] + 1)]
    table = spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in (zip(*cells, strict=True) if cells else [[]] * 6)], names=["length", "cell", "rank_from", "rank_to", "first", "offset"]))
    strides = F.broadcast(spark.createDataFrame(pa.table({"length": pa.array(stride, pa.int64()), "stride": pa.array(stride.values(), pa.int64())})))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth")).join(strides, "length")
    ranked = ranked.withColumn("cell", F.floor(F.col("rank") / F.col("stride")))
    # the runs are bounded by the number of lengths, not by the corpus
    placed = ranked.join(F.broadcast(table), ["length", "cell"]).where("rank >= rank_from and rank < rank_to")
    placed = placed.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("rank_from"))
    return placed.drop("part", "nth", "before", "rank", "stride", "cell", "rank_from", "rank_to", "first")


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    pieces = common.staged(spark, pieces_of(docs, path, limit, end_id), "pieces")
    return pack(spark, pieces, limit).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
