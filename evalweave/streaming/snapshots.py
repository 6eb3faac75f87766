"""Counts of categories in windows of event time, over a stream of observation files.

Optional: batches and streams share the expression, so a finished stream equals the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..roles import CATEGORY


def category_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, category, n) of windows of ``width``."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.expr(CATEGORY).alias("category"))
    return rows.withWatermark("ts", "1 hour").groupBy(F.window("ts", width).alias("w"), "category").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "category", "n")


def run_once(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, files: str = "*.parquet") -> None:
    """Counts all files that are there and ends. Windows are written when the watermark has passed them, each
    once: the checkpoint remembers what was read, and the file sink what was committed."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(source)
    counts = category_counts(stream)
    counts.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
