"""SimHash near-dedup with a byte-position inverted index and count filtering.

Fingerprints of 64 bits are eight positional bytes. Two that differ in at most four bits share at least four of
them, the guaranteed minimum. The inverted index posts a fingerprint under its rarest positional bytes only, in one
order of rarity for all: two that share four of eight must share one among the five rarest of each (WIDTH 1), two among
the six rarest, or three among the seven rarest. In a posting list the shared positional bytes of each pair are
tallied; pairs that reach the minimum are verified by their differing bits. Lists are kept for distinct fingerprints
only, so exact copies cost nothing.

A list's key has as many positional bytes as keep lists short: one up to some 10^5 distinct fingerprints, then two,
three and four. All of these find the same pairs; only the work differs.

From each list come the links of a spanning forest, not all pairs: a search that starts from one fingerprint takes
up everything near it, and what has been taken up is not compared again. Buckets of lists above BLOCK entries are cut
into blocks whose pairs are separate tasks.

Texts: A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, shingles four words joined by a space (fewer words: all
of them; none, or a null text: fingerprint zero). Ties of bits (set in exactly half the shingles) give 0. Repeated rows
are one fingerprint and stay rows of their own. A null doc_id is never the smallest: a group has the smallest doc_id
that isn't null, or null if all are (2^63 - 1 counts as null). Columns other than doc_id and text are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, SEED = 4, 42
MAX_BITS, BYTES = 4, 8
SHARED = BYTES - MAX_BITS  # bytes that a linked pair is sure to share
#: Fingerprints in a bucket of posting lists, on average, in a block of a bucket at most, and in a list on average at most.
BUCKET, BLOCK, LIST = 1 << 16, 1 << 19, 256


def choices(width: int) -> list[tuple[int, ...]]:
    """The positions that a list's key may take its bytes from."""
    return list(combinations(range(BYTES), width))


def mask_of(choice: tuple[int, ...]) -> np.uint64:
    return np.uint64(sum(0xFF << 8 * p for p in choice))


def width_for(n: int) -> int:
    """Positional bytes in a key so that lists of `n` fingerprints have LIST entries on average at most, if bytes were even."""
    for width in range(1, SHARED):
        posted, lists = math.comb(SHARED + width, width), math.comb(BYTES, width) << 8 * width
        if n * posted <= LIST * lists:
            return width
    return SHARED


def fingerprints(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each of the texts laid end to end."""
    upper = (raw >= 65) & (raw <= 90)
    raw = raw + (upper * np.uint8(32))
    starts, stops, bounds = common.word_spans(raw, ends)
    # the words of all rows with one space after each
    size = stops - starts
    until = np.cumsum(size + 1)
    keep = np.zeros(len(raw) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, stops, -1)
    joined = np.full(int(until[-1]) if len(until) else 0, 32, np.uint8)
    begin = until - size - 1
    slot = np.ones(len(joined), bool)
    slot[until - 1] = False
    joined[slot] = raw[np.cumsum(keep[:-1]) > 0]
    data = joined.tobytes()

    words = np.diff(bounds)
    last = np.repeat(bounds[1:], words) - 1  # of each word: the last word of its row
    index = np.arange(len(starts))
    stop_at = np.minimum(index + SHINGLE - 1, last)
    first_of_row = index == np.repeat(bounds[:-1], words)
    begins = np.flatnonzero((index + SHINGLE - 1 <= last) | first_of_row & (index + SHINGLE - 1 > last))
    a, b = begin[begins].tolist(), (until[stop_at[begins]] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(begins))

    out = np.zeros(len(words), np.uint64)
    cuts = np.searchsorted(begins, bounds)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for row in range(len(words)):
        i, j = int(cuts[row]), int(cuts[row + 1])
        if i == j:
            continue
        total = np.zeros(64, np.int64)
        for k in range(i, j, 1 << 16):
            bits = np.unpackbits(hashes[k : min(j, k + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(0, dtype=np.int32)
        out[row] = weights[2 * total > j - i].sum(dtype=np.uint64)
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint long): the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            prints = fingerprints(*common.text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint long")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs: the shared positional bytes are tallied, and where they reach the minimum the differing bits are counted."""
    differ = np.ascontiguousarray(a ^ b)
    shared = (differ.view(np.uint8).reshape(*differ.shape, BYTES) == 0).sum(-1, dtype=np.uint8)
    out = shared >= SHARED
    out[out] = np.bitwise_count(differ[out]) <= MAX_BITS
    return out


def forest(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is near within one posting list of distinct fingerprints."""
    links = []
    # begin where the bits are the majority's: in a group of near copies that reaches most of them at once
    bits = np.unpackbits(members.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    centre = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(members), bitorder="little").view(np.uint64)[0]
    rest = members[np.argsort(np.bitwise_count(members ^ centre), kind="stable")]
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            reached = []
            # as many of the frontier at a time as keep the table of comparisons small
            step = max(1, min(len(frontier), (1 << 20) // len(rest)))
            for i in range(0, len(frontier), step):
                block = frontier[i : i + step]
                hit = near(block[:, None], np.broadcast_to(rest, (len(block), len(rest))))
                found = hit.any(0)
                if found.any():
                    links.append((block[hit[:, found].argmax(0)], rest[found]))
                    reached.append(rest[found])
                    rest = rest[~found]
                    if not len(rest):
                        break
            frontier = np.concatenate(reached) if reached else frontier[:0]
    return links


def bucket_links(prints: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Links within the posting lists of one choice of positions."""
    prints = np.unique(prints)
    prints = prints[np.argsort(prints & mask, kind="stable")]
    key = prints & mask
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    links = []
    small = np.repeat(size <= 8, size)
    for d in range(1, 8):  # short lists: all at once
        i = np.flatnonzero((key[:-d] == key[d:]) & small[:-d])
        if not len(i):
            break
        a, b = prints[i], prints[i + d]
        ok = near(a, b)
        links.append((a[ok], b[ok]))
    for k in np.flatnonzero(size > 8):
        links += forest(prints[edge[k] : edge[k + 1]])
    if not links:
        return prints[:0], prints[:0]
    return tuple(np.concatenate(x) for x in zip(*links, strict=True))


def rarity(prints: DataFrame) -> np.ndarray:
    """[8, 256]: the place of each positional byte in one order from the rarest to the most frequent; 2048 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BYTES << 8, np.int64)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, BYTES) + 256 * np.arange(BYTES)
            total += np.bincount(at.reshape(-1), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])

    counts = prints.select("fingerprint").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BYTES << 8, np.int64)
    n[counts["at"].to_numpy()] = counts["n"].to_numpy()
    order = np.empty(len(n), np.int64)
    order[np.lexsort((np.arange(len(n)), n))] = np.arange(len(n))
    return order.reshape(BYTES, 256)


def posted_under(prints: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each fingerprint the set of its positions, as bits, that are among its SHARED + width rarest."""
    places = order[np.arange(BYTES), prints.view(np.uint8).reshape(-1, BYTES)]
    kept = np.argsort(places, axis=1)[:, : SHARED + width]
    return np.bitwise_or.reduce(np.left_shift(1, kept), axis=1)


def links_of(prints: DataFrame) -> DataFrame:
    """Links that connect all distinct fingerprints within MAX_BITS of each other: a and b, structs of (low, print).

    prints: (fingerprint long, low long), staged, distinct. A node's order is that of its `low`, the smallest doc_id.
    """
    spark, n = prints.sparkSession, prints.count()
    buckets, width = max(1, n // BUCKET), width_for(n)
    order = rarity(prints)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, lows = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
            under = posted_under(every, order, width)
            for c, choice in enumerate(choices(width)):
                bits = sum(1 << p for p in choice)
                chosen = np.flatnonzero(under & bits == bits)
                where = (common.mix64((every[chosen] & mask_of(choice)) + np.uint64(c)) % np.uint64(buckets)).astype(np.int64)
                by_bucket = np.argsort(where, kind="stable")
                found, first = np.unique(where[by_bucket], return_index=True)
                parts = [np.stack([every[x], lows[x]]).tobytes() for x in np.split(chosen[by_bucket], first[1:])] if len(chosen) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), c), pa.int32()), pa.array(found), pa.array([len(p) // 16 for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    names=["choice", "bucket", "n", "prints"],
                )

    posted = prints.select("fingerprint", "low").mapInArrow(post, "choice int, bucket long, n long, prints binary")
    posted = common.staged(spark, posted, "postings")
    sizes = posted.groupBy("choice", "bucket").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    units = posted.join(sizes, ["choice", "bucket"]).withColumn("own", F.pmod(F.xxhash64("prints"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("choice", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "prints")

    def link(key: tuple, group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in group["prints"].to_pylist()]
        every, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        low = np.concatenate([p[1] for p in parts])[first].view(np.int64)
        ends = bucket_links(every, mask_of(choices(width)[key[0].as_py()]))
        columns = {}
        for name, end in zip("ab", ends, strict=True):
            columns |= {f"{name}_low": pa.array(low[np.searchsorted(every, end)]), name: pa.array(end.view(np.int64))}
        return pa.table(columns)

    got = units.groupBy("choice", "bucket", "lo", "hi").applyInArrow(link, "a_low long, a long, b_low long, b long")
    links = common.staged(spark, got, "links")
    common.discard(posted)
    return links.select(*[F.struct(F.col(f"{c}_low").alias("low"), F.col(c).alias("print")).alias(c) for c in "ab"])


def near_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint string, component_id) of every row; component_id is the smallest doc_id that links reach."""
    each = common.staged(spark, fingerprinted(docs), "fingerprints")
    prints = common.staged(spark, each.groupBy("fingerprint").agg(F.coalesce(F.min("doc_id"), F.lit(common.NO_ID)).alias("low"), F.count("*").alias("n")), "prints")
    links = links_of(prints)
    roots = common.components(spark, links, "simhash").select(F.col("id.print").alias("print"), F.col("root.low").alias("root"))
    common.discard(links)
    # nodes are ordered by their smallest doc_id, so the root's is the component's: one row a fingerprint, no key gathers more
    of_print = prints.join(roots, prints["fingerprint"] == roots["print"], "left").select("fingerprint", "n", F.nullif(F.coalesce("root", "low"), F.lit(common.NO_ID)).alias("component_id"))
    out = common.join_hot(each, of_print, "fingerprint", each.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
