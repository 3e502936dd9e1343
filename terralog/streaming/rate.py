"""Request-rate check: clients above a number of requests per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The default allowance.
WINDOW = "2 minutes"
MAX_REQUESTS = 400


def rate_breaches(
    events: DataFrame,
    ts: str = "ts",
    client: str = "client",
    window: str = WINDOW,
    max_requests: int = MAX_REQUESTS,
    lateness: str = "1 minute",
) -> DataFrame:
    """``client, window_start, window_end, n, rejected`` for each breach.

    Works on batch and streaming events.  Counts combine on the map side, so a
    client that sends most of the events is one row per partition in the
    shuffle.  On a stream, ``lateness`` bounds the state: a window is final once
    the watermark passes its end.  A stream needs a zoned timestamp, so a plain
    one is read in the session time zone.
    """
    if events.isStreaming:
        events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    counts = events.groupBy(F.window(ts, window).alias("_w"), F.col(client).alias("client")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.where(F.col("n") > max_requests).select(
        "client",
        F.col("_w.start").alias("window_start"),
        F.col("_w.end").alias("window_end"),
        "n",
        (F.col("n") - max_requests).alias("rejected"),
    )
