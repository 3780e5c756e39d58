"""Sinks: published generations, a journal of changes over a base, caches by content, bounded output."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import shared_dir


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """`df` written into the shared folder, by the columns named, and read back."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)


class Generations:
    """A table of which each change is a whole new generation, seen once its number is published."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/generations-{uuid.uuid4().hex}"
        self.last = 0

    def stage(self, df: DataFrame) -> int:
        """Writes a generation that nobody sees yet."""
        self.last += 1
        df.write.mode("overwrite").parquet(f"{self.path}/generation={self.last}")
        return self.last

    def publish(self, generation: int) -> None:
        """The generation is the current one from now on; those that are never published are rolled back."""
        self.spark.createDataFrame([(generation,)], "generation int").coalesce(1).write.mode("append").parquet(f"{self.path}-published")

    def current(self) -> DataFrame:
        told = self.spark.read.parquet(f"{self.path}-published").agg(F.max("generation")).first()[0]
        return self.spark.read.parquet(f"{self.path}/generation={told}")


def journal(base: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """`base` after the deltas (the same columns with `seq` and `deleted`): the last change of a key counts, tombstones take it away."""
    values = F.struct(*base.columns, "deleted")
    every = base.withColumns({"seq": F.lit(0), "deleted": F.lit(False)}).unionByName(deltas)
    last = every.groupBy(key).agg(F.max_by(values, "seq").alias("x")).select("x.*")
    return last.where("not deleted").select(*base.columns)


def misses(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct hashes of inputs that the cache (hash) doesn't hold."""
    return inputs.select("hash").distinct().join(cache.select("hash").distinct(), "hash", "left_anti")


def envelope(**fields: Column) -> Column:
    """A JSON object of the fields."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def bounded_output(rows: DataFrame, size: Column, budget: int, *order: Column | str, most: int = 1000) -> DataFrame:
    """Whole rows in order until the first that doesn't fit into `budget`; of at most `most` rows."""
    first = rows.orderBy(*order).limit(most)
    used = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("used", used).where(F.col("used") <= budget).drop("used")
