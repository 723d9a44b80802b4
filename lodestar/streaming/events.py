"""Additions for streams of events: windowed counts with a watermark, and latest states kept by foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.latest import latest_columns


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and type; events later than the watermark are dropped, so state stays bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def keep_latest(stream: DataFrame, path: str, checkpoint: str):
    """Append each batch's latest state of each user as a batch-numbered partition; rerun batches overwrite their own."""

    def write(batch: DataFrame, number: int) -> None:
        latest_columns(batch, ["user_id"], ["ts", "event_id"], ["ts", "event_id", "event_type"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
