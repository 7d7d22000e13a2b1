"""Fragment coverage of an unbounded fragment stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time_col: str = "ts", key_col: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, key, n, distinct barcodes (approximate) by event time; rows later than the watermark are dropped."""
    marked = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    counted = marked.groupBy(F.window(time_col, window).alias("w"), F.col(key_col).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("barcodes"))
    return counted.select(F.col("w.start").alias("window_start"), "key", "n", "barcodes")


def stream_table(spark, folder: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)
