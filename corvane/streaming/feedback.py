"""Streaming form of the weekly feedback summary (an extension: the batch form is in operators/monitoring)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.monitoring import feedback_summary


def weekly(feedback: DataFrame, ts: str = "created_at", late: str = "2 days", weeks: str = "7 days") -> DataFrame:
    """total, up, down, down_rate and alert of each tumbling window; works on batch and streaming input.

    The watermark lets state of closed weeks go; rows later than ``late`` are left out of a stream's windows.
    """
    rows = feedback.withWatermark(ts, late) if feedback.isStreaming else feedback
    out = feedback_summary(rows.withColumn("w", F.window(ts, weeks)), keys=("w",))
    return out.select(F.col("w.start").alias("week_start"), F.col("w.end").alias("week_end"), "total", "up", "down", "down_rate", "alert")


def start(feedback: DataFrame, path: str, checkpoint: str, **kw: str) -> StreamingQuery:
    """Writes closed weeks to Parquet, each once; a restart goes on from ``checkpoint``."""
    return weekly(feedback, **kw).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
