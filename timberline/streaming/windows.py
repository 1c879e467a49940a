"""Running profiles and scores of streams: the batch aggregates with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.spec import valid


def windowed_profile(events: DataFrame, time: str, value: str, by: list[str], length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Per window and group: rows, missing, sum, least and greatest value.

    Runs on a stream and on a table alike; on a stream, rows later than
    ``late`` behind the newest are dropped and a window's state goes with it.
    """
    rows = events.withColumn("__time", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__time", late)
    window = F.window("__time", length, slide) if slide else F.window("__time", length)
    v = valid(value)
    out = rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("missing"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("greatest"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "missing", "total", "least", "greatest")


def sessions(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows per session of activity."""
    rows = events.withColumn("__time", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__time", late)
    out = rows.groupBy(F.session_window("__time", gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def running_confusion(scored: DataFrame, time: str, score: Column, label: Column, length: str = "1 day", late: str = "1 hour", threshold: float = 0.5) -> DataFrame:
    """Confusion counts per window."""
    rows = scored.withColumn("__time", F.col(time).cast("timestamp"))
    if scored.isStreaming:
        rows = rows.withWatermark("__time", late)
    said = score >= threshold
    out = rows.groupBy(F.window("__time", length).alias("w")).agg(
        F.count_if(said & (label == 1)).alias("tp"), F.count_if(said & (label == 0)).alias("fp"), F.count_if(~said & (label == 0)).alias("tn"), F.count_if(~said & (label == 1)).alias("fn")
    )
    return out.select(F.col("w.start").alias("window_start"), "tp", "fp", "tn", "fn")


def score_stream(events: DataFrame, expression: Column, name: str = "prediction") -> DataFrame:
    """Scores of a stream: a projection without state."""
    return events.withColumn(name, expression)
