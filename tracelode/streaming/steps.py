"""Steps as a stream: windowed label counts and sessions with a watermark. An extension; the batch operators do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(window, label, n) per tumbling window; rows later than `late` are left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), F.col("event_type").alias("label")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(trace_id, window, steps, errors) per session of a trace."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), F.col("user_id").alias("trace_id")).agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "error").alias("errors"))
