"""Debounced change events, as a batch and as a stream, and an idempotent upsert sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounced(events: DataFrame, quiet: str) -> DataFrame:
    """(path, first, last, n): one row for each burst of a path's events that lie less than `quiet` apart.

    The same plan runs on a stream: give the events a watermark first; a burst is out once it has been quiet.
    """
    bursts = events.groupBy("path", F.session_window("ts", quiet)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return bursts.drop("session_window")


def start_debounced(events: DataFrame, quiet: str, lateness: str, table: str, checkpoint: str):
    """Streams bursts into a memory table; at most `lateness` late events count."""
    return debounced(events.withWatermark("ts", lateness), quiet).writeStream.outputMode("append").format("memory").queryName(table).option("checkpointLocation", checkpoint).start()


def start_upsert(events: DataFrame, key: str, order: str, path: str, checkpoint: str):
    """Keeps the latest row of each key in a folder with one generation for each batch; a repeated batch writes the same."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest = batch
        if epoch:
            latest = spark.read.schema(batch.schema).parquet(f"{path}/generation={epoch - 1}").unionByName(batch)
        others = [c for c in batch.columns if c != key]
        latest = latest.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("x")).select(key, "x.*")
        latest.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/generation={epoch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def bounded_bursts(events: DataFrame, key: str, quiet: int, most: int) -> DataFrame:
    """(key, first, last, n): bursts of a key's events that lie less than `quiet` seconds apart, released after `most` seconds at the latest."""
    by = Window.partitionBy(key).orderBy("ts")
    starts = F.when(F.lag("ts").over(by).isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp")) >= quiet * 1_000_000), 1).otherwise(0)
    numbered = events.withColumn("starts", starts).withColumn("burst", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    age = micros - F.min(micros).over(Window.partitionBy(key, "burst"))
    cut = numbered.withColumn("part", F.floor(age / (most * 1_000_000)))
    return cut.groupBy(key, "burst", "part").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("burst", "part")
