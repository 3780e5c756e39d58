"""Language-model scoring with a log-frequency Bloom filter.

One pass over the texts counts: tasks hold a chunk of documents at a time and send each bucket of fingerprints the
distinct words, bigrams and trigrams of the chunk that belong to it, with their training counts. Each bucket adds them
up, builds its segment of the filter, and answers every chunk: the exact training count of each of its words, and the
levels that the segment gives back for its n-grams. A chunk's documents travel as ranks of words; with the answers of
all buckets, which hold its words and the buckets' totals too, they are scored. Nothing is broadcast, as the model grows
with the corpus, and nothing is staged: the disk holds what the two shuffles move. A word in a third of all texts is one
entry of a chunk.

The filter holds quantised counts: an n-gram seen c times has the level of the largest of LOWEST that is not above c.
It is inserted once for each level up to its own, so a count is read back by probing level after level until one is
missing. A segment is as large as its n-grams need to set at most FILL of its bits, whatever their number; no n-gram is
left out. With low(x) and high(x) the least and the greatest count of the level read back for x,

    P(w)     = (low(w) + 1) / (N + V + 1)
    P(w|v)   = (low(v w) + MU[0] P(w)) / (high(v) (1 + f) + V f + MU[0])
    P(w|u v) = (low(u v w) + MU[1] P(w|v)) / (high(u v) (1 + f) + V f + MU[1])

where f is the rate at which a probe finds what isn't there. Contexts that were never seen leave P as it is. As the
counts of what follows a context add up to at most its own, and V f stands for what false probes add, the
probabilities of all words after a context add up to at most 1 (in the mean over the filter's hashes). The base score
uses the exact counts.

Words are told apart by 64 bits of a digest under a secret key, bigrams and trigrams by 48 bits made of them.

Texts: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, then one end token; null texts are the end alone. Rows that share a
doc_id are scored each, and each counts. A row with a null doc_id trains. Columns other than doc_id and text are not
read. Without any training row all counts are 0. An empty table gives an empty result.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .substring import grow, shrink

#: Tokens that a task holds before it sends them, and tokens of a bucket on average; both grow up to MOST times with large
#: corpora, as a chunk and a bucket have one row for each other.
HELD, BUCKET, MOST = 2 << 20, 2 << 20, 4
#: Probes of each level; the share of a segment's bits that may be set at most; how often a probe finds what isn't there.
PROBES, FILL = 20, 0.5
FALSE = FILL**PROBES
#: What the lower orders weigh in P(w|v) and P(w|u v), in counts.
MU = (4.0, 1.0)
#: The fingerprint of the end token.
END = np.uint64(0x5851F42D4C957F2D)


def _lowest() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, np.int64)


#: The least count of each level from 1 on: each but the first few is half as much again as the one before.
LOWEST = _lowest()

GRAMS = ("words", "bigrams", "trigrams")
#: head: the documents of a chunk, with the bucket that its number falls into.
HEAD = ("ids", "nulls", "trains", "n_tokens", "tf", "ranks")
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in HEAD), *((f"{g}{x}", pa.binary()) for g in GRAMS for x in ("", "_counts"))])
SENT = "bucket int, chunk long, " + ", ".join(f"{c} binary" for c in _SENT_ARROW.names[2:])
#: A bucket's answer to a chunk, with the chunk's words in it, the chunk's head in one of them, and the bucket's totals.
_GIVEN_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in (*HEAD, "words", "counts", *(f"{g}_levels" for g in GRAMS))), ("total", pa.int64()), ("distinct_words", pa.int64())])
GIVEN = "bucket int, chunk long, " + ", ".join(f"{c} binary" for c in _GIVEN_ARROW.names[2:-2]) + ", total long, distinct_words long"


def tokens_of(column: pa.Array, digests: common.Digests) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the tokens of all rows, ends included, and the n + 1 offsets of the rows."""
    raw, ends = common.text_bytes(column)
    raw = raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32))
    starts, stops, bounds = common.word_spans(raw, ends)
    return np.insert(digests.of(raw, starts, stops)[:, 0], bounds[1:], END), bounds + np.arange(len(bounds))


def ngram_hashes(tokens: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For bigrams, then trigrams, of rows of `size` tokens: (index of the last token of each, fingerprints of 48 bits)."""
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
    whole = tokens
    for n in (1, 2):
        longer = np.zeros(len(tokens), np.uint64)
        longer[1:] = common.mix64(whole[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:])
        whole = longer
        inside = np.flatnonzero(at >= n)
        yield inside, whole[inside] >> np.uint64(16)


def _counted(hashes: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of 48 bits in order, and how many of each are flagged."""
    both = np.sort(hashes << np.uint64(1) | flags.astype(np.uint64))
    keys = both >> np.uint64(1)
    lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[lead], np.add.reduceat((both & np.uint64(1)).astype(np.int64), lead) if len(lead) else lead


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, the sums of their counts, and the place of each list's keys among them."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
    return distinct, total, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype("<u4")


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers in Rice's code: the low bits of each gap as they are, the rest of it in unary.

    Fingerprints are evenly spread, so this is within a tenth of a bit each of what they must take.
    """
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values)
    width = int(np.log2(max(1.0, gaps.mean()))) if n > 1 else 0
    width = min(width, max(0, width - 1), key=lambda w: w * len(gaps) + int((gaps >> np.uint64(w)).sum()))
    high = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + len(gaps), bool)
    unary[np.cumsum(high + 1) - 1] = True
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    whole, odd = divmod(width, 8)
    out = [bytes([width]), n.to_bytes(8, "little"), int(values[0]).to_bytes(8, "little"), planes[:, :whole].T.tobytes()]
    if odd:
        out.append(np.packbits(np.unpackbits(planes[:, whole : whole + 1], axis=1, count=odd, bitorder="little")).tobytes())
    return b"".join([*out, np.packbits(unary).tobytes()])


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    whole, odd = divmod(blob[0], 8)
    n, raw = int.from_bytes(blob[1:9], "little") - 1, np.frombuffer(blob, np.uint8)[17:]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :whole] = raw[: whole * n].reshape(whole, n).T
    raw = raw[whole * n :]
    if odd:
        planes[:, whole] = np.packbits(np.unpackbits(raw, count=odd * n).reshape(n, odd), axis=1, bitorder="little")[:, 0]
        raw = raw[-(-odd * n // 8) :]
    high = np.diff(np.flatnonzero(np.unpackbits(raw)), prepend=-1) - 1
    out = np.empty(n + 1, np.uint64)
    out[0] = int.from_bytes(blob[9:17], "little")
    out[1:] = planes.view("<u8")[:, 0] | high.astype(np.uint64) << np.uint64(blob[0])
    return np.cumsum(out, dtype=np.uint64)


class _Counts:
    def __init__(self, bits: int, key: bytes):
        self.bits, self.digests = bits, common.digests_of(key)
        self.clear()

    def clear(self) -> None:
        self.tokens, self.bounds, self.ids, self.trains, self.held = [], [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        tokens, bounds = tokens_of(batch.column(1), self.digests)
        self.tokens.append(tokens)
        self.bounds.append(np.diff(bounds))
        self.ids.append(batch.column(0))
        self.trains.append(~batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
        self.held += len(tokens)

    def send(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """A row for each bucket; one also has the documents of the chunk."""
        tokens, size, trains = (np.concatenate(x) for x in (self.tokens, self.bounds, self.trains))
        ids = pa.chunked_array(self.ids).combine_chunks()
        self.clear()
        trained = np.repeat(trains, size)
        words, place = np.unique(tokens, return_inverse=True)
        grams = [(words, np.bincount(place[trained], minlength=len(words)), 64)]
        grams += [(*_counted(hashes, trained[last]), 48) for last, hashes in ngram_hashes(tokens, size)]
        # frequent words have low ranks, which are packed tighter
        tf = np.bincount(place, minlength=len(words))
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-tf, kind="stable")] = np.arange(len(words))
        head = [shrink(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")), np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes(), np.packbits(trains).tobytes(), shrink(size.astype("<i8"))]
        head += [shrink(_small(tf)), shrink(_small(rank[place]))]
        edges = [np.searchsorted(h >> np.uint64(width - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)) if self.bits else np.array([0, len(h)]) for h, _, width in grams]
        home = int(common.mix64(np.array([chunk + 1], np.uint64))[0]) & ((1 << self.bits) - 1)
        for b in range(1 << self.bits):
            row = [b, chunk, *(head if b == home else [None] * len(head))]
            for (hashes, counts, _), edge in zip(grams, edges, strict=True):
                part = slice(edge[b], edge[b + 1])
                row += [pack_sorted(hashes[part]), shrink(_small(counts[part]))]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SENT_ARROW, strict=True)], schema=_SENT_ARROW)
        common.trim()


def level_of(counts: np.ndarray) -> np.ndarray:
    """The level of each count; 0 is that of 0."""
    return np.searchsorted(LOWEST, counts, "right")


def low_of(levels: np.ndarray) -> np.ndarray:
    """The least count of each level."""
    return np.concatenate([[0.0], LOWEST.astype(float)])[levels]


def high_of(levels: np.ndarray) -> np.ndarray:
    """The greatest count of each level."""
    return np.concatenate([[0.0], LOWEST[1:] - 1.0, [LOWEST[-1] * 2.0]])[levels]


class Filter:
    """A segment of the filter: `entries` n-gram levels in a bit set (of less than 2**32 bits) of which they set FILL at most."""

    def __init__(self, entries: int):
        self.bits = max(1 << 13, int(np.ceil(entries * PROBES / -np.log(1 - FILL))) + 1)
        self.bytes = np.zeros(-(-self.bits // 8), np.uint8)

    def _probes(self, hashes: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """The bit of each of the probes of n-grams at one level."""
        a = common.mix64(hashes ^ np.uint64(level * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        b = common.mix64(a) | np.uint64(1)
        for _ in range(PROBES):
            yield ((a >> np.uint64(32)) * np.uint64(self.bits) >> np.uint64(32)).astype(np.int64)
            a = a + b

    def insert(self, *grams: tuple[np.ndarray, np.ndarray]) -> None:
        """All levels of (fingerprints, levels) of several kinds at once."""
        bits = np.zeros(self.bits, bool)
        for hashes, levels in grams:
            for level in range(1, int(levels.max(initial=0)) + 1):
                for at in self._probes(hashes[levels >= level], level):
                    bits[at] = True
        self.bytes |= np.packbits(bits, bitorder="little")

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each fingerprint, 0 if it isn't held, by repeated probes."""
        out = np.zeros(len(hashes), np.uint8)
        live, level = np.arange(len(hashes)), 1
        while len(live):
            hit = np.ones(len(live), bool)
            for at in self._probes(hashes[live], level):
                hit &= (self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            live = live[hit]
            out[live] = level
            level += 1
        return out


def _count(key: tuple, sent: pa.Table) -> pa.Table:
    """What a bucket knows, told to each chunk: exact counts of its words, and the levels in its segment of the filter."""
    out = {c: [] for c in _GIVEN_ARROW.names}

    def put(**row: object) -> None:
        for c in out:
            out[c].append(row.get(c))

    bucket, rows = key[0].as_py(), sent.to_pylist()
    found = [_summed([unpack_sorted(r[g]) for r in rows], [grow(r[f"{g}_counts"], "<u4") for r in rows]) for g in GRAMS]
    # fingerprints of different orders are told apart by a bit that none of them has
    tagged = [(keys if n == 0 else keys | np.uint64(n << 62), level_of(counts)) for n, (keys, counts, _) in enumerate(found)]
    model = Filter(int(sum(levels.sum() for _, levels in tagged)))
    model.insert(*((keys[levels > 0], levels[levels > 0]) for keys, levels in tagged))
    known = [model.levels(keys) for keys, _ in tagged]
    counts = found[0][1]
    totals = {"total": int(counts.sum()), "distinct_words": int((counts > 0).sum())}
    for i, row in enumerate(rows):
        answer = {f"{g}_levels": shrink(levels[places[i]]) for g, levels, (_, _, places) in zip(GRAMS, known, found, strict=True)}
        put(bucket=bucket, chunk=row["chunk"], **{c: row[c] for c in (*HEAD, "words")}, counts=shrink(counts[found[0][2][i]].astype("<i8")), **answer, **totals)
    common.trim()
    return pa.table(out, schema=_GIVEN_ARROW)


def probabilities(first: np.ndarray, words: np.ndarray, bigrams: np.ndarray, trigrams: np.ndarray, total: int, distinct_words: int) -> np.ndarray:
    """P of each token of rows laid end to end, from the levels of the word, bigram and trigram that end with it; first: where rows begin."""
    false = distinct_words * FALSE
    p = (low_of(words) + 1) / (total + distinct_words + 1)
    for mu, whole, context in zip(MU, (bigrams, trigrams), (words, bigrams), strict=True):
        before = np.zeros(len(words))
        before[1:] = high_of(context)[:-1]
        before[first] = 0
        longer = (np.minimum(low_of(whole), before) + mu * p) / (before * (1 + FALSE) + false + mu)
        p = np.where(before > 0, longer, p)
    return p


def _gather(group: pa.Table) -> pa.Table:
    """The scores of a chunk's documents, from the answers of all buckets."""
    rows = group.sort_by("bucket").to_pylist()
    total, distinct_words = (sum(r[x] for r in rows) for x in ("total", "distinct_words"))
    head = next(r for r in rows if r["ids"] is not None)
    size = grow(head["n_tokens"], "<i8")
    n = len(size)
    nulls, trains = (np.unpackbits(np.frombuffer(head[x], np.uint8), count=n).astype(bool) for x in ("nulls", "trains"))
    # buckets in order are fingerprints in order
    exact = np.concatenate([grow(r["counts"], "<i8") for r in rows])
    levels = [np.concatenate([grow(r[f"{g}_levels"], "u1") for r in rows]) for g in GRAMS]
    place = np.argsort(-grow(head["tf"], "<u4").astype(np.int64), kind="stable")[grow(head["ranks"], "<u4")]
    tokens = np.concatenate([unpack_sorted(r["words"]) for r in rows])[place]
    told = [levels[0][place]]
    for (last, hashes), known in zip(ngram_hashes(tokens, size), levels[1:], strict=True):
        of = np.zeros(len(tokens), np.uint8)
        of[last] = known[np.unique(hashes, return_inverse=True)[1]]
        told.append(of)
    first = np.cumsum(size) - size
    p = probabilities(first, *told, total, distinct_words)
    sums = lambda x: np.add.reduceat(x, first)
    base = sums(np.log10(exact + 1.0)[place]) - size * np.log10(float(total + distinct_words + 1))
    out = {"doc_id": pa.array(grow(head["ids"], "<i8"), mask=nulls), "held_out": ~trains, "n_tokens": size, "n_known": sums((exact > 0).astype(np.int64)[place])}
    out |= {"train_tokens": np.full(n, total, np.int64), "base_score": base, "score": sums(np.log10(p))}
    common.trim()
    return pa.table(out)


def held_out():
    """Rows that nothing is learned from: crc32 of the doc_id as text, mod 7, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    docs = docs.select("doc_id", "text", held_out().alias("held_out"))
    tokens = (docs.select(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    grown = min(MOST, max(1.0, (tokens / (1 << 32)) ** 0.5))
    bits = max(0, int(tokens // (grown * BUCKET)).bit_length())
    limit, key = int(grown * HELD), secrets.token_bytes(32)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, chunk = _Counts(bits, key), TaskContext.get().partitionId() << 24
        for batch in common.text_slices(batches):
            counts.add(batch)
            if counts.held >= limit:
                yield from counts.send(chunk)
                chunk += 1
        if counts.held:
            yield from counts.send(chunk)

    given = docs.mapInArrow(send, SENT).groupBy("bucket").applyInArrow(_count, GIVEN)
    return given.groupBy("chunk").applyInArrow(_gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
