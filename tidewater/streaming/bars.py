"""Structured Streaming: events to five-minute bars, and a stateless scorer over finished feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.forecast import predict_har


def stream_bars(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Bars of an event stream; a bar closes once the watermark has passed it, later events are dropped."""
    at = F.struct("ts", "event_id")
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .filter(F.col("value") > 0)
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"))
        .agg(
            F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
            F.sum("value").alias("volume"), F.count("*").alias("trades"),
        )
        .select(F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "trades")
    )


def stream_scores(features: DataFrame, model: dict) -> DataFrame:
    """A forecast for each feature row that arrives; no state."""
    return predict_har(features, model, "forecast")
