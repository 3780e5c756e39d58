"""Aggregations: counts, coverage, BM25, rank fusion, graph statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed constants of the ranking formulas.
K1, B, RRF = 1.2, 0.75, 60


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): distinct undirected neighbours; candidate edges don't count."""
    e = edges.where("kind <> 'DispatchCandidate'")
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(e.select("dst", "src")).distinct()
    return both.groupBy("id").agg(F.count("*").alias("degree"))


def rrf(ranked: DataFrame, k: int = RRF) -> DataFrame:
    """(id, score) of (id, source, rank): each source gives 1 / (k + best rank)."""
    best = ranked.groupBy("id", "source").agg(F.min("rank").alias("rank"))
    return best.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.count("*").alias("sources"))


def terms_of(text: Column) -> Column:
    """Lower-case alphanumeric terms, repeats included."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


#: Folders that postings are dealt into by a hash of their term, and tasks that write one of them.
TERM_FOLDERS, SPREAD = 64, 8


def term_folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_FOLDERS)).cast("int")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, id, tf, dl) of batches (id, terms): one row for each term of a batch, with arrays of its texts in order."""
    for batch in batches:
        ids, terms = batch.column("id"), batch.column("terms")
        coded = terms.flatten().dictionary_encode()
        n = max(1, len(ids))
        at, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + pc.list_parent_indices(terms).to_numpy(), return_counts=True)
        term, row = at // n, at % n
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        offsets = pa.array(np.append(starts, len(at)), pa.int32())
        dl = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[row]
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids.take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(dl, pa.int32()))]
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[starts])), *lists], ["term", "id", "tf", "dl"])


def postings(texts: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(term, id, tf, dl, field, folder) of each field (name: column) of each text; written by folder and sorted by term, a query reads its terms only.

    A row is a block: a term with arrays of the texts of one batch that have it. Texts are counted where they are read, so only blocks travel.
    """
    every, kind = None, texts.schema[key].dataType.simpleString()
    for field, column in fields.items():
        terms = texts.select(F.col(key).alias("id"), terms_of(F.col(column)).alias("terms"))
        counted = terms.mapInArrow(blocks_of, f"term string, id array<{kind}>, tf array<int>, dl array<int>").withColumn("field", F.lit(field))
        every = counted if every is None else every.union(counted)
    every = every.withColumn("folder", term_folder(F.col("term")))
    # a folder is dealt by ids too, so that a term in every text doesn't stand in one task
    return every.repartition("folder", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("folder", "term")


def lengths(texts: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, n, avgdl): one row for each field."""
    sizes = [F.struct(F.lit(f).alias("field"), F.size(terms_of(F.col(c))).alias("dl")) for f, c in fields.items()]
    return texts.select(F.explode(F.array(*sizes)).alias("x")).groupBy("x.field").agg(F.count("*").alias("n"), F.avg("x.dl").alias("avgdl"))


def bm25_of(stored: DataFrame, sizes: DataFrame, query: list[str], boosts: dict[str, float] | None = None) -> DataFrame:
    """(id, score) from stored `postings` and `lengths`: fields add up, each with its boost."""
    query = list(dict.fromkeys(query))
    folders = [r[0] for r in stored.sparkSession.createDataFrame([(q,) for q in query], "q string").select(term_folder(F.col("q"))).distinct().collect()]
    mine = stored.where(F.col("folder").isin(folders) & F.col("term").isin(query))
    df = mine.groupBy("term", "field").agg(F.sum(F.size("id")).alias("df"))
    # one row for each term of the query and field
    weights = df.join(F.broadcast(sizes), "field").withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    if boosts:
        score = score * F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair])[F.col("field")]
    found = mine.join(F.broadcast(weights), ["term", "field"]).select("term", "field", "idf", "avgdl", F.inline(F.arrays_zip("id", "tf", "dl")))
    # parts are added in the order of the query, so that equal texts have equal scores to the last bit
    place = F.array_position(F.array(*map(F.lit, query)), F.col("term"))
    parts = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "field", score.alias("part")))).alias("parts"))
    return parts.select("id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))


def risk(direct: int, cross: int, total: int) -> str:
    """The risk of a change from its direct, cross-repository and total dependents."""
    score = 4 * direct + 8 * cross + total
    return "high" if score >= 40 or cross >= 3 else "medium" if score >= 12 or cross else "low"


def dead_code(edges: DataFrame, symbols: DataFrame, entry: Column | None = None) -> DataFrame:
    """Symbols that nothing but an owner points to and that are no entry points, with their outgoing edges; none outgoing is medium confidence."""
    symbols = symbols if entry is None else symbols.where(~entry)
    used = edges.where("kind not in ('Defines')").select(F.col("dst").alias("id")).distinct()
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outgoing"))
    rest = symbols.join(used, "id", "left_anti").join(out, "id", "left").withColumn("outgoing", F.coalesce("outgoing", F.lit(0)))
    return rest.select("id", "name", "outgoing", F.when(F.col("outgoing") == 0, "medium").otherwise("high").alias("confidence"))


def segment_max(scored: DataFrame) -> DataFrame:
    """(id, score): the best of a symbol's segments, before any cut."""
    return scored.groupBy("id").agg(F.max("score").alias("score"))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_duplicate(rows: DataFrame, keys: tuple[str, ...], earliest: str) -> DataFrame:
    """Of rows with equal keys the earliest."""
    w = Window.partitionBy(*keys).orderBy(earliest)
    return rows.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


def community_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, members, repos, internal, boundary) of nodes (id, community, repo); an edge between two communities is a boundary of both."""
    a, b = (nodes.select(F.col("id").alias(end), F.col("community").alias(c)) for end, c in (("src", "a"), ("dst", "b")))
    met = edges.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.count("*").alias("n"))
    inside = F.col("a") == F.col("b")
    sides = met.select(F.col("a").alias("community"), F.when(inside, F.col("n")).otherwise(0).alias("internal"), F.when(inside, 0).otherwise(F.col("n")).alias("boundary"))
    sides = sides.union(met.where(~inside).select("b", F.lit(0), "n"))
    totals = sides.groupBy("community").agg(F.sum("internal").alias("internal"), F.sum("boundary").alias("boundary"))
    members = nodes.groupBy("community").agg(F.count("*").alias("members"), F.count_distinct("repo").alias("repos"))
    return members.join(totals, "community").select("community", "members", "repos", "internal", "boundary")
