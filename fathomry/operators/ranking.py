"""Ordered operators: ranks, windows, diversification, paging, fusion of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame, source: str, k: int) -> DataFrame:
    """(id, source, rank) of the k best of a channel."""
    top = scores.orderBy(F.desc("score"), "id").limit(k)
    return top.select("id", F.lit(source).alias("source"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def islands(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, first, last, n) of runs of consecutive numbers, repeats counted once; missing numbers are a run of their own.

    Rows are sorted once and nothing is gathered in a table: only the ends of runs are kept, and a run's first row meets its last.
    """
    w, now = Window.partitionBy(key).orderBy(at), F.col(at)
    first = (F.row_number().over(w) == 1) | (now.isNotNull() & (F.lag(at).over(w).isNull() | (now - F.lag(at).over(w) > 1)))
    last = now.isNotNull() & (F.lead(at).over(w).isNull() | (F.lead(at).over(w) - now > 1))
    ends = rows.select(key, at).withColumns({"first_": first, "last_": last}).where("first_ or last_")
    ends = ends.withColumn("end_", F.when(F.col("last_") | now.isNull(), now).otherwise(F.lead(at).over(w))).where("first_")
    n = F.coalesce(F.col("end_") - now + 1, F.lit(1)).cast("long")
    return ends.select(key, now.alias("first"), F.col("end_").alias("last"), n.alias("n"))


def sliding_chunks(texts: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, n, start, content): windows of `size` characters that overlap; the last ends with the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(float(step)))).cast("int")
    cut = texts.select(key, F.col(text).alias("t_"), F.posexplode(F.sequence(F.lit(0), last)).alias("n", "i"))
    start = F.col("i") * step
    return cut.select(key, "n", start.alias("start"), F.substr("t_", start + 1, F.lit(size)).alias("content"))


def diversify(scored: DataFrame, limit: int, quota: int) -> DataFrame:
    """Rows (id, source, score) so that no source has more than `quota` before all others had theirs, then filled by score."""
    by = Window.partitionBy("source").orderBy(F.desc("score"), "id")
    late = F.when(F.row_number().over(by) > quota, 1).otherwise(0)
    return scored.withColumn("late", late).orderBy("late", F.desc("score"), "id").limit(limit)


def diversified(ranked: DataFrame, limit: int, prefer_sources: bool) -> DataFrame:
    """(id, source, section, score, round): `limit` rows in four rounds, by score within a round.

    First one row of each source (with `prefer_sources`), then first rows of other sections, then other rows, all while
    their source has less than half of the limit, then whatever is left.
    """
    most = max(1, limit // 2)
    order = (F.desc("score"), "id")
    section, source = Window.partitionBy("source", "section"), Window.partitionBy("source")
    rows = ranked.withColumns({"of_section": F.row_number().over(section.orderBy(*order)), "of_source": F.row_number().over(source.orderBy(*order))})
    first = F.col("of_section") == 1
    rows = rows.withColumns({"nth_first": F.sum(first.cast("int")).over(source.orderBy(*order)), "firsts": F.sum(first.cast("int")).over(source)})
    taken = first & (F.col("nth_first") <= most)
    rows = rows.withColumn("taken", taken)
    nth_rest = F.sum((~F.col("taken")).cast("int")).over(source.orderBy(*order))
    one = F.lit(prefer_sources) & (F.col("of_source") == 1)
    round_ = F.when(one, 0).when(F.col("taken"), 1 if prefer_sources else 0).when(nth_rest <= most - F.least(F.lit(most), F.col("firsts")), 2).otherwise(3)
    chosen = rows.withColumn("round", round_).orderBy("round", *order).limit(limit)
    return chosen.select("id", "source", "section", "score", "round")


def coverage(texts: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Adds the number of distinct terms that a text has as whole words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return texts.withColumn("coverage", F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))))


def within_budget(rows: DataFrame, limit: int) -> DataFrame:
    """The rows, or an error if there are more than `limit`."""
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def latest_per_key(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The last row of each key, by an aggregate."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x")).select(key, "x.*")


def heading_stack(headings: DataFrame, key: str, at: str, level: str) -> DataFrame:
    """Adds h1 to h3: the places of the headings above each; a heading ends those of its own level and deeper."""
    upto = Window.partitionBy(key).orderBy(at)
    last = {n: F.max(F.when(F.col(level) == n, F.col(at))).over(upto) for n in (1, 2, 3)}
    out = headings.withColumns({f"p{n}": c for n, c in last.items()})
    one, two = F.coalesce("p1", F.lit(-1)), F.coalesce("p2", F.lit(-1))
    return out.withColumns({"h1": F.col("p1"), "h2": F.when(F.col("p2") > one, F.col("p2")), "h3": F.when(F.col("p3") > F.greatest(one, two), F.col("p3"))}).drop("p1", "p2", "p3")


def first_per_key(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The first `n` rows of each key, with the number of those left out."""
    by = Window.partitionBy(key)
    numbered = rows.withColumns({"n_": F.row_number().over(by.orderBy(*order)), "omitted": F.greatest(F.count("*").over(by) - n, F.lit(0))})
    return numbered.where(F.col("n_") <= n).drop("n_")


def token_page(ranked: DataFrame, order: tuple[Column, ...], offset: int, limit: int) -> DataFrame:
    """A page of at most 1000 ranked rows (id), with `position` and a `token` that changes when the ranking does."""
    placed = within_budget(ranked, 1000).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    ids = F.array_sort(F.collect_list(F.struct("position", F.col("id").cast("string").alias("id"))))
    token = placed.agg(F.sha2(F.array_join(F.transform(ids, lambda x: x["id"]), ","), 256).alias("token"))
    return placed.where((F.col("position") > offset) & (F.col("position") <= offset + limit)).crossJoin(F.broadcast(token))
