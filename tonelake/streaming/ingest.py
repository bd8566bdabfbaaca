"""Streaming ingest of submissions and events: an extension beyond the batch operators.

Sources are folders of Parquet files with a stated schema. Repeated deliveries are dropped within a watermark, so state
is bounded by the lateness allowed; windows close when the watermark passes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_folder(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_deliveries(stream: DataFrame, key: list[str], at: str, lateness: str = "30 days") -> DataFrame:
    """The first delivery of each key within the lateness allowed."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, at: str, by: list[str], window: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Rows per event-time window and key: tumbling, or sliding with `slide`."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    counted = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).groupBy(w, *by).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "rows")


def session_counts(stream: DataFrame, at: str, by: list[str], gap: str, lateness: str) -> DataFrame:
    """Rows per session of each key, sessions being split by gaps in event time."""
    counted = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).groupBy(F.session_window(at, gap), *by).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "rows")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops; a further run goes on where this one ended, each file being taken exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
