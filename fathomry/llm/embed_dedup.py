"""Embedding near-dedup with Euclidean p-stable hashing.

Vectors are normalised. A table's key is the tuple of `width` quantised random projections floor((a x + b) / W), a
drawn from the normal distribution; near vectors fall into one bucket of some table with a probability known from
their distance. The length of the tuple follows the number of vectors, so that far vectors share few buckets, and the
number of tables follows from the length and the recall that is asked for at the threshold itself.

Only class and bucket numbers are shuffled to find out which buckets hold two classes or more; vectors go to these
alone. In a bucket all pairs are checked with the exact cosine in double precision, in blocks: buckets above BLOCK rows
are dealt into blocks, and each pair of blocks is a task of its own; small buckets share a task. No pairs are emitted: a
task gives the number of links of each vector, a pair counting in the first table in which it meets (the earlier keys
are computed again for pairs that link), and the edges of a spanning forest.

Equal vectors are one class with its number of rows. Vectors that are null, empty or zero, or that hold a null or a
non-finite component, link with nothing; vectors of another dimension than the rest only meet their like. A null
vec_id is a row of its own and never the smallest of a component unless all are null (2^63 - 1 counts as null); rows that
share a vec_id are vectors each. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COSINE = 0.95
#: Width of a quantisation step, the recall asked for at COSINE, and how many far vectors may share a bucket.
STEP, RECALL, FAR = 2.0, 0.97, 64
BLOCK = 2048
#: Rows of small buckets that share a unit of work, on average.
UNIT = 20_000


def collide(distance: float, step: float = STEP) -> float:
    """The probability that one projection of two vectors at a distance has the same quantised value."""
    r = step / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape_of(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(projections in a key, tables) for `n` vectors."""
    width = max(1, math.ceil(math.log(max(1.0, n / FAR)) / -math.log(collide(math.sqrt(2)))))
    near = collide(math.sqrt(2 - 2 * cosine)) ** width
    return width, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near)))


@lru_cache(maxsize=4)
def _projections(dimension: int, width: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(np.random.SeedSequence([dimension, width, tables]))
    return rng.standard_normal((dimension, width * tables)), rng.uniform(0, STEP, width * tables)


def table_keys(unit: np.ndarray, width: int, tables: int, first: int | None = None) -> np.ndarray:
    """The bucket of each vector in each of the `first` tables (all), as 64-bit numbers [n, first]."""
    a, b = _projections(unit.shape[1], width, tables)
    first = tables if first is None else first
    cells = np.floor((unit @ a[:, : first * width] + b[: first * width]) / STEP).astype(np.int64).view(np.uint64).reshape(len(unit), first, width)
    out = np.full((len(unit), first), unit.shape[1], np.uint64)
    for j in range(width):
        out = common.mix64(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return out.view(np.int64)


def _normalised(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, key): key is the vector's bytes in double precision, null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for v in batch.column(1).to_pylist():
                x = np.array(v, float) if v and None not in v else np.zeros(0)
                keys.append((x + 0.0).astype("<f8").tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["vec_id", "key"])

    return vectors.mapInArrow(run, "vec_id long, key binary")


def _linked(unit: np.ndarray, bucket: np.ndarray, own: np.ndarray, split: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by bucket) of one bucket that link, found block by block; with `split` only pairs of two blocks."""
    if split:
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
        for i in range(0, len(left), 256):
            a, b = np.nonzero(unit[left[i : i + 256]] @ unit[right].T >= cosine)
            yield left[i + a], right[b]
        return
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    size = np.diff(edge)
    small = np.repeat(size <= 8, size)
    for d in range(1, min(8, len(bucket))):  # small buckets: all at once
        a = np.flatnonzero((bucket[:-d] == bucket[d:]) & small[:-d])
        for i in range(0, len(a), 1 << 14):
            x = a[i : i + (1 << 14)]
            hit = np.einsum("ij,ij->i", unit[x], unit[x + d]) >= cosine
            yield x[hit], x[hit] + d
    for k in np.flatnonzero(size > 8).tolist():
        begin, end = int(edge[k]), int(edge[k + 1])
        for i in range(begin, end, 256):
            a, b = np.nonzero(unit[i : min(i + 256, end)] @ unit[i:end].T >= cosine)
            later = a < b
            yield i + a[later], i + b[later]


def _merged(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`parent` (each row's representative, the smallest of its set) after the sets of all pairs were united."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _checked(group: pa.Table, table: int, split: bool, shape: tuple[int, int], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, the representative of each row) of one unit."""
    weight, own, bucket = group["rows"].to_numpy(), group["own"].to_numpy(), group["bucket"].to_numpy()
    unit = _normalised(group["key"].to_pylist())
    counts, parent = np.zeros(len(own), np.int64), np.arange(len(own))
    for a, b in _linked(unit, bucket, own, split, cosine):
        if table and len(a):  # met in an earlier table: counted there, and linked there
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = table_keys(unit[used], *shape, table)
            fresh = ~(keys[place[: len(a)]] == keys[place[len(a) :]]).any(1)
            a, b = a[fresh], b[fresh]
        counts += np.bincount(a, weight[b], len(own)).astype(np.int64) + np.bincount(b, weight[a], len(own)).astype(np.int64)
        parent = _merged(parent, a, b)
    return counts, parent


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding)."""
    each = common.staged(spark, _classes(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")), "vectors")
    classes = each.where("key is not null").groupBy("key").agg(F.coalesce(F.min("vec_id"), F.lit(common.NO_ID)).alias("low"), F.count("*").alias("rows"))
    # a number of its own for each class, as rows may share an id
    classes = common.staged(spark, classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    shape = width, tables = shape_of(classes.count(), cosine)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            sizes = np.array([len(k) for k in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                keys = table_keys(_normalised([raw[i] for i in at]), width, tables)
                ids = np.repeat(batch.column(1).to_numpy(zero_copy_only=False)[at], tables)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(keys.reshape(-1))], names=["class_id", "table", "bucket"])

    dealt = common.staged(spark, classes.select("key", "class_id").mapInArrow(spread, "class_id long, table int, bucket long"), "buckets")
    # only buckets of two classes or more go on
    sizes = dealt.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    units = max(1, dealt.count() // UNIT // tables)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    # a bucket above BLOCK is a unit of its own for each pair of its blocks, smaller ones share a unit
    member = dealt.join(sizes, ["table", "bucket"]).withColumn("own", F.pmod(F.xxhash64("class_id"), blocks).cast("int"))
    member = member.withColumns({"other": F.explode(F.sequence(F.lit(0), blocks - 1)), "unit": F.when(blocks > 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(units)))})
    member = member.select("class_id", "table", "bucket", "unit", (blocks > 1).alias("large"), "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    placed = member.join(classes, "class_id")

    def link(key: tuple, group: pa.Table) -> pa.Table:
        table, _, _, lo, hi = (k.as_py() for k in key)
        group = group.sort_by("bucket")
        split = lo != hi
        if split and len(group["own"].unique()) < 2:
            group = group.slice(0, 0)
        out = {c: [] for c in ("low", "id", "to_low", "to_id", "n")}
        sizes = np.array([len(k) for k in group["key"].to_pylist()], np.int64)
        for size in np.unique(sizes):  # vectors of one dimension
            part = group.take(pa.array(np.flatnonzero(sizes == size)))
            if split and len(part["own"].unique()) < 2:
                continue
            counts, parent = _checked(part, table, split, shape, cosine)
            low, ids = part["low"].to_numpy(), part["class_id"].to_numpy()
            found, child = np.flatnonzero(counts), np.flatnonzero(parent != np.arange(len(parent)))
            none = [None] * len(found)
            for c, counted, joined in (("low", low[found], low[child]), ("id", ids[found], ids[child]), ("to_low", none, low[parent[child]]), ("to_id", none, ids[parent[child]]), ("n", counts[found], [None] * len(child))):
                out[c] += [*counted, *joined]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    got = placed.groupBy("table", "unit", "large", "lo", "hi").applyInArrow(link, "low long, id long, to_low long, to_id long, n long")
    got = common.staged(spark, got, "links")
    common.discard(dealt)
    counts = got.where("to_id is null").groupBy(F.col("id").alias("class_id")).agg(F.sum("n").alias("links"))
    node = lambda low, id: F.struct(F.col(low).alias("low"), F.col(id).alias("id"))
    roots = common.components(spark, got.where("to_id is not null").select(node("low", "id").alias("a"), node("to_low", "to_id").alias("b")), "vectors")
    # nodes are ordered by their smallest vec_id, so the root's is the component's
    roots = roots.select(F.col("id.id").alias("class_id"), F.col("root.low").alias("root"))
    known = classes.join(counts, "class_id", "left").join(roots, "class_id", "left")
    links = (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).cast("long")
    known = known.select("key", F.col("rows").alias("n"), links.alias("n_links"), F.nullif(F.coalesce("root", "low"), F.lit(common.NO_ID)).alias("component_id"))
    linked = common.join_hot(each.where("key is not null"), known, "key", each.count()).select("vec_id", "n_links", "component_id")
    out = linked.union(each.where("key is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
