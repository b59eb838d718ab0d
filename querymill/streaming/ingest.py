"""Streams of evidence and events: resumable ingest, deduplication, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive, in a folder or as one file; the schema is that of the files there are."""
    schema = spark.read.parquet(path).schema
    # as a pattern, since a stream takes a path that is none for a folder
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by tumbling window and type; state older than the watermark is dropped."""
    window = F.window("ts", width)
    return (
        events.filter("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window, "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total"))


def new_evidence(evidence: DataFrame, late: str = "30 days") -> DataFrame:
    """Evidence without repeats of the same check, within the time a repeat may be late."""
    keys = ["idx", "backend", "stage", "sql", "checked_at"]
    typed = evidence.withColumns({"backend": F.lower(F.trim("backend")), "checked_at": F.col("checked_at").cast("timestamp")}).filter("checked_at IS NOT NULL")
    return typed.withWatermark("checked_at", late).dropDuplicatesWithinWatermark(keys)


def sink_complete(df: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """The whole result after every batch, over the last one; a batch run twice leaves the same."""
    return (
        df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(table)).start())


def sink_append(df: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", table).start()
