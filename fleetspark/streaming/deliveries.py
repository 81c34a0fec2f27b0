"""T-7 / T-2 on a stream: stateless delivery checks, windowed wake flags.

The per-request checks are ``operators.webhook.deliveries_status`` (a
stateless projection with the class label sets inlined as a literal), so
the stream and the batch share one definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import EPOCH_NTZ, epoch_to_ts
from ..operators.webhook import deliveries_status


def delivery_stream(requests: DataFrame, secret: bytes, label_sets: Column) -> DataFrame:
    """T-7: status, signature check and wake flag for each request (stateless)."""
    return deliveries_status(requests, secret, label_sets).select("event_id", "ts", "signature_ok", "status", "wake")


def wake_windows(deliveries: DataFrame, interval: str, watermark: str) -> DataFrame:
    """T-2: per tumbling event-time window, whether any delivery woke the
    poller, and how many did.  Late rows beyond the watermark are dropped."""
    # Watermarks need an instant (TIMESTAMP); the NTZ wall clock is UTC, so
    # convert through epoch micros (independent of the session time zone).
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), F.col("ts")))
    return (deliveries.withColumn("_event_time", instant).withWatermark("_event_time", watermark)
            .groupBy(F.window("_event_time", interval).alias("w"))
            .agg(F.bool_or("wake").alias("wake"), F.count_if("wake").alias("matching"))
            .select(epoch_to_ts(F.unix_micros(F.col("w.start")) / F.lit(1e6)).alias("window_start"), "wake", "matching"))
