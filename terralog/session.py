"""Settings for sessions that run this library."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Spark's own mechanisms for skew and size: adaptive execution picks broadcast
# joins from measured sizes, merges small shuffle partitions and splits skewed
# ones, also where that costs another shuffle.  On a cluster, set
# spark.sql.shuffle.partitions to about the largest shuffle's size / 128 MB.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    # A longer top-k sorts on disk instead of holding its rows in memory.
    "spark.sql.execution.topKSortFallbackThreshold": "1000000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def builder(app: str = "terralog") -> SparkSession.Builder:
    made = SparkSession.builder.appName(app)
    for name, value in SETTINGS.items():
        made = made.config(name, value)
    return made
