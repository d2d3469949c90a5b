"""Incremental work over arriving files, as streams that stop when done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, files: int = 100) -> int:
    """Hands the Parquet files that came since the last call to ``handle``, in
    batches of ``files`` at most, and returns the number of batches. Progress
    is in ``checkpoint``: a call that broke off goes on where it stopped."""
    seen = []

    def run(batch: DataFrame, number: int) -> None:
        handle(batch, number)
        seen.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(seen)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by key and tumbling window; rows later than ``late`` are left out
    once their window is closed. Works on streams and on tables."""
    marked = events.withWatermark(time, late)
    return marked.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")
