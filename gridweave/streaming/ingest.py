"""Streaming ingestion of staged tiles and windowed counts of their arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema, files: str = "*.parquet", max_files: int = 64) -> DataFrame:
    """Parquet files as they appear in a folder; ``max_files`` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", files).parquet(folder)


def arrivals(rows: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per key and tumbling window; state is dropped once the watermark has passed a window."""
    timed = rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", window), key).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), key, "n")


def sessions(rows: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Rows per key and session; a session ends after ``gap`` without a row."""
    timed = rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.session_window("_at", gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").cast("timestamp_ntz").alias("from_at"), F.col("session_window.end").cast("timestamp_ntz").alias("to_at"), key, "n")


def append_staged(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Publish staged tiles as they arrive: a batch replaces the partitions of its tiles' runs.

    Each micro-batch writes its own folder ``batch=<id>``, so a batch that is
    delivered again after a failure replaces what the first try left.
    """

    def publish(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates().write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_counts(path_rows: DataFrame) -> DataFrame:
    """The newest count of each tile among the appended batches."""
    return path_rows.groupBy("run_id", "tile_id").agg(F.max_by("n", F.struct("updated_at", "arrived_at", "n")).alias("n"))
