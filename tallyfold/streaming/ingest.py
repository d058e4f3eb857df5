"""Stored series kept up to date from files as they arrive.

Each micro-batch is reduced to one row for each series and time (sum and count) and written as one folder of the store,
named by the batch's number: a batch that is run again after a failure overwrites its own folder, so that nothing counts
twice. Reading the store adds the folders up; compacted writes them as one folder of a new store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, series_id: Column, time: Column, value: Column, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start adding (series_id, time, value) of a streaming DataFrame to the store. Rows without id or time are left out."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.select(series_id.alias("series_id"), time.alias("time"), value.cast("double").alias("value")).filter("series_id is not null and time is not null")
        part = rows.groupBy("series_id", "time").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
        part.write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(series_id, time, value): the mean of all values that have arrived."""
    parts = spark.read.parquet(store)
    return parts.groupBy("series_id", "time").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("value"))


def compacted(spark: SparkSession, store: str, to: str) -> None:
    """Write the store anew, one row for each series and time, as batch -1 of another folder, where a stream that is started with that folder goes on adding."""
    parts = spark.read.parquet(store)
    parts.groupBy("series_id", "time").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{to}/batch=-1")
