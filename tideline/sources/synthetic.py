"""A made table for benchmarks, of any size, the same for a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def benchmark_table(spark: SparkSession, rows: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """event_id, timestamp_ns, relative_spread and realized_vol_20 (lognormal), trade_intensity (Poisson-like), correct (0 or 1).

    Made by executors from seeded columns; a number of partitions is part of what a seed gives.
    """
    if rows <= 0:
        raise ValueError("the number of rows must be positive")
    base = spark.range(0, rows, 1, partitions or max(1, rows // 1_000_000))
    u = F.rand(seed + 2)
    term, cdf, count = 0.0497870684, 0.0, F.lit(0)  # Poisson of mean 3 by its distribution function
    for k in range(16):
        cdf += term
        count = count + (u > F.lit(cdf)).cast("int")
        term *= 3.0 / (k + 1)
    return base.select(
        F.col("id").alias("event_id"), (F.col("id") * 1_000_000).alias("timestamp_ns"), F.exp(F.randn(seed) * 0.5 - 14.0).alias("relative_spread"), F.exp(F.randn(seed + 1) * 0.75 - 10.0).alias("realized_vol_20"),
        count.cast("int").alias("trade_intensity"), (F.rand(seed + 3) < 0.6).cast("byte").alias("correct"),
    )
