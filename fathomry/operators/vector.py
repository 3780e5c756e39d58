"""Vector search over (id, v array<double>): exact, and by clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Centres of an index at most.
MOST_CENTRES = 100


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def normalized(a: Column) -> Column:
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))


def scored(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(id, score): every vector against the one row of `query` (q)."""
    return vectors.crossJoin(F.broadcast(query.select("q").limit(1))).select("id", cosine(F.col("v"), F.col("q")).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best, ties by id: one heap a task, then k rows."""
    return scores.orderBy(F.desc("score"), "id").limit(k)


def centroids(vectors: DataFrame, cluster: str) -> DataFrame:
    """(cluster, c): the elementwise mean of each cluster, normalised."""
    parts = vectors.select(cluster, F.posexplode("v").alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x"))
    mean = parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return mean.select(F.col(cluster).alias("cluster"), normalized(F.col("c")).alias("c"))


def assign(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster, v) with the nearest centre, the first of equals; each row looks at all centres, so none is multiplied."""
    every = centres.limit(MOST_CENTRES + 1).agg(F.collect_list(F.struct("cluster", "c")).alias("centres"))  # bounded
    every = every.where(F.assert_true(F.size("centres") <= MOST_CENTRES, F.lit(f"more than {MOST_CENTRES} centres")).isNull())
    near = F.array_max(F.transform("centres", lambda x: F.struct(cosine(F.col("v"), x["c"]).alias("s"), (-x["cluster"]).alias("k"))))
    return vectors.crossJoin(F.broadcast(every)).select("id", (-near["k"]).alias("cluster"), "v")


def ivf_search(assigned: DataFrame, centres: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k best of the cluster nearest to the query; `assigned` is stored by cluster, and the others aren't read."""
    near = centres.crossJoin(query.select("q").limit(1)).select("cluster", cosine(F.col("c"), F.col("q")).alias("s"))
    first = near.orderBy(F.desc("s"), "cluster").first()  # of at most MOST_CENTRES rows
    return top(scored(assigned.where(F.col("cluster") == (first["cluster"] if first else None)), query), k)


def relative_cutoff(scores: DataFrame, k: int) -> DataFrame:
    """What reaches 0.9 of the k-th score (the k-th score itself where it isn't positive)."""
    kth = scores.orderBy(F.desc("score"), "id").limit(k).agg(F.min("score").alias("kth"))
    floor = F.when(F.col("kth") > 0, 0.9 * F.col("kth")).otherwise(F.col("kth"))
    return scores.crossJoin(F.broadcast(kth)).where(F.col("score") >= floor).drop("kth")


def kmeans(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, cluster, v): k-means by cosine from k-means|| starts; vectors without a length are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(norm(F.col("v")) > 0).withColumn("features", array_to_vector("v"))
    model = KMeans(k=min(k, MOST_CENTRES), seed=seed, distanceMeasure="cosine", maxIter=100, tol=1e-4, predictionCol="cluster").fit(rows)
    return model.transform(rows).select("id", "cluster", "v")
