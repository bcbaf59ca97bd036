"""Daily counts over streams of quotes and trades: event time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.events import valid_quote


def daily_quotes(quotes: DataFrame, lateness: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """window_start, rows, invalid rows of a stream (or table) with ``us`` in event time.

    Rows later than ``lateness`` behind the newest are left out, as a closed window is final.
    """
    timed = quotes.withColumn("at", F.timestamp_micros("us")).withWatermark("at", lateness)
    counted = timed.groupBy(F.window("at", width)).agg(F.count(F.lit(1)).alias("rows"), F.sum((~valid_quote()).cast("long")).alias("invalid_rows"))
    return counted.select(F.col("window.start").alias("window_start"), "rows", "invalid_rows")
