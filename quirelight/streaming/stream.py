"""The row-local operators over documents as they arrive, and events by windows of time.

Page operators keep no state, so a stream runs them as a batch does. Counts by window keep state until the watermark
passes a window's end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelight.functions.text import char_f1, normalise
from quirelight.sources.bridge import degraded


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files: int = 100) -> DataFrame:
    """Documents from Parquet files that arrive in a folder, at most `files` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def scored(documents: DataFrame, every: int = 17) -> DataFrame:
    """doc_id, chars, char_f1 of each document against its degraded copy; works on streams and tables."""
    rows = documents.select("doc_id", normalise(F.coalesce("text", F.lit(""))).alias("truth"))
    return rows.select("doc_id", F.length("truth").alias("chars"), char_f1(F.col("truth"), degraded(F.col("truth"), F.col("doc_id"), every)).alias("char_f1"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; the timestamp without a zone is cast, as watermarks need."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
