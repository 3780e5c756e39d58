"""Bounded traversals and components over an edge table (src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shared_dir

IMPACT_KINDS = ("Calls", "Uses", "Implements", "Extends", "References", "DispatchCandidate")


class BudgetExceeded(ValueError):
    """A traversal met more nodes or edges than it may; there is no partial result."""


def neighbours(edges: DataFrame, node: int, kinds: tuple[str, ...], reverse: bool = False) -> DataFrame:
    """(id, kind, line) of the edges that leave, or enter, a node."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.where((F.col(a) == node) & F.col("kind").isin(*kinds)).select(F.col(b).alias("id"), "kind", "line")


def reach(edges: DataFrame, starts: DataFrame, depth: int, max_nodes: int | None = None, max_edges: int | None = None) -> DataFrame:
    """(id, depth) of nodes within `depth` steps along src -> dst, starts at 0. The frontier is joined, never collected.

    Edges are staged once and read at each step; parallel edges count towards `max_edges`.
    """
    shared_dir(edges.sparkSession)
    edges = edges.select("src", "dst") if max_edges is not None else edges.select("src", "dst").distinct()
    edges = edges.checkpoint()
    seen = starts.select("id").distinct().withColumn("depth", F.lit(0)).checkpoint()
    walked = 0
    for step in range(1, depth + 1):
        frontier = seen.where(F.col("depth") == step - 1).select(F.col("id").alias("src"))
        crossed = edges.join(frontier, "src")
        if max_edges is not None:
            walked += crossed.count()
            if walked > max_edges:
                raise BudgetExceeded(f"more than {max_edges} edges")
        new = crossed.select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(step)).checkpoint()
        if new.isEmpty():
            break
        seen = seen.union(new)
        if max_nodes is not None and seen.limit(max_nodes + 1).count() > max_nodes:
            raise BudgetExceeded(f"more than {max_nodes} nodes")
    return seen


def impact(edges: DataFrame, start: int, depth: int, max_nodes: int | None = None, max_edges: int | None = None) -> DataFrame:
    """(id, depth) of what depends on a node, itself left out."""
    if not 1 <= depth <= 10:
        raise ValueError("depth is 1 to 10")
    back = edges.where(F.col("kind").isin(*IMPACT_KINDS)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    starts = edges.sparkSession.createDataFrame([(start,)], "id long")
    return reach(back, starts, depth, max_nodes, max_edges).where(F.col("id") != start)


def path(edges: DataFrame, start: int, end: int, depth: int = 16) -> DataFrame:
    """(position, id) of a shortest path, the smallest ids of all shortest ones seen from the end; no rows if there is none."""
    spark = edges.sparkSession
    shared_dir(spark)
    hops = edges.select("src", "dst").distinct().checkpoint()
    levels = reach(hops, spark.createDataFrame([(start,)], "id long"), depth)
    found = levels.where(F.col("id") == end).first()
    rows = []
    if found:
        node = end
        for d in range(found["depth"], 0, -1):  # at most `depth` rows
            rows.append((d, node))
            before = levels.where(F.col("depth") == d - 1).select(F.col("id").alias("src"))
            node = hops.where(F.col("dst") == node).join(before, "src").agg(F.min("src")).first()[0]
        rows.append((0, node))
    return spark.createDataFrame(rows, "position int, id long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component), component the smallest id; candidate edges don't connect. Stars are contracted until they stand still."""
    shared_dir(edges.sparkSession)
    e = edges.where("kind <> 'DispatchCandidate'").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct().checkpoint()
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        up = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().checkpoint()
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        after = up.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct().checkpoint()
        several = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        chained = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        e = after
        if several.isEmpty() and chained.isEmpty():
            break
    heads = e.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(heads)
