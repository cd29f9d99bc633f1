"""Continuous ingestion: new chunks appended once, and search statistics over event time.

Extensions: the batch operators used on streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_once(chunks: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append a stream of chunks to a Parquet folder, each micro-batch under its own number.

    A batch that is run again after a failure overwrites its own folder, so rows are stored exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_searches(log: DataFrame, window: str = "1 hour", late: str = "3 days") -> DataFrame:
    """Searches per window of their time and mode; repeated rows within the allowed lateness count once."""
    timed = log.where(F.col("ts_query").isNotNull()).withWatermark("ts_query", late)
    once = timed.dropDuplicatesWithinWatermark(["query_id"]) if log.isStreaming else timed.dropDuplicates(["query_id"])
    return once.groupBy(F.window("ts_query", window).alias("w"), F.coalesce("search_mode", F.lit("unknown")).alias("search_mode")).agg(F.count(F.lit(1)).alias("searches"), F.count_if(F.col("error_code").isNotNull()).alias("errors")).select(F.col("w.start").alias("window_start"), "search_mode", "searches", "errors")
