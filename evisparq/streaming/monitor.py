"""Streaming extensions: an hourly failure monitor and an answering service.

The engine's own operators are batch operators; these are additions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Rows and failures by hour; on a stream, hours close when the watermark has passed them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failures")).select(F.col("w.start").alias("hour"), "n", "failures")


def serve(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str) -> StreamingQuery:
    """Answers each micro-batch of requests and appends the rows; a batch that is run again overwrites its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
