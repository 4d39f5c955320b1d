"""Incremental ingestion: files that arrive in a folder are chunked and appended once.

The batch package has no streaming counterpart to match; this reuses its operators under Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.chunking import chunks


def incoming(spark: SparkSession, folder: str, schema: str = "seq long, text string, language string, arrived timestamp") -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def ingest(stream: DataFrame, path: str, checkpoint: str, size: int = 512, overlap: int = 64):
    """Start a query that chunks each micro-batch and appends it; a replayed batch overwrites its own folder."""

    def store(batch: DataFrame, epoch: int) -> None:
        chunks(batch.select("seq", "text", "language"), size, overlap).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    fresh = stream.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["seq"])
    return fresh.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_rates(events: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Requests of each user in sliding windows, as a streaming aggregate."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "user_id").agg(F.count("*").alias("requests"))
