"""Progress of streams, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """batch, rows, ms of the stream's recent batches, as many as Spark keeps."""
    seen = [(p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0)) for p in query.recentProgress]
    return spark.createDataFrame(seen, "batch long, rows long, ms long")
