"""Aggregates over an open time interval before each event: trades with t - L < trade time < t.

Time is cut into blocks as wide as L, so the interval of an event at t is the part before t of its own block and the part
after t - L of the block before. Both are running sums of one pass, forwards and backwards in a block, so the work follows
the number of rows and not that of trades in an interval. Nothing is subtracted: no inequality join, no cancellation.
Buckets of whole blocks make it parallel: a trade is copied to the buckets that it can reach (two at most), an event stays
in its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import DAY_US, maker_sign
from tideline.operators.ordering import bucket_width


def open_interval_sums(events: DataFrame, trades: DataFrame, lookback_us: int, values: dict[str, str], key: str = "event_id", us: str = "us", bucket_us: int = DAY_US) -> DataFrame:
    """Events' (key, us) with, for each name -> column of ``trades``, its sum over the open interval (0 if empty).

    Values must be integers or doubles that add exactly for results independent of the order.
    """
    width = -(-max(bucket_us, lookback_us) // lookback_us) * lookback_us
    t_us = F.col(us)
    e = events.select(F.col(key).alias("id"), t_us.alias("us"), (t_us - lookback_us).alias("start"), *[F.lit(None).cast(trades.schema[c].dataType).alias(n) for n, c in values.items()], F.floor(t_us / width).alias("bucket"))
    t = trades.select(F.lit(None).cast("long").alias("id"), t_us.alias("us"), t_us.alias("start"), *[F.col(c).alias(n) for n, c in values.items()], F.explode(F.sequence(F.floor(t_us / width), F.floor((t_us + lookback_us - 1) / width))).alias("bucket"))
    united = e.unionByName(t).repartition("bucket")
    for c in ("us", "start"):
        united = united.withColumn(f"{c}_block", F.col(c) - F.pmod(F.col(c), F.lit(lookback_us)))
    ahead = Window.partitionBy("bucket", "us_block").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("bucket", "start_block").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    summed = united.select("id", "us", *[(F.coalesce(F.sum(n).over(ahead), F.lit(0)) + F.coalesce(F.sum(n).over(behind), F.lit(0))).alias(n) for n in values])
    return summed.where(F.col("id").isNotNull()).select(F.col("id").alias(key), F.col("us").alias(us), *values)


def trade_flow(events: DataFrame, trades: DataFrame, lookback_us: int, bucket_us: int | None = None) -> DataFrame:
    """event_id, us, trade_count, signed_count, volume, signed_volume over the open interval before each event.

    The width of time buckets follows the number of events and trades, unless it is given.
    """
    bucket_us = bucket_us or bucket_width(events.select("us").unionAll(trades.select("us")), least=lookback_us)
    sign = maker_sign(F.col("buyer_is_maker"))
    t = trades.select("us", F.lit(1).cast("long").alias("one"), sign.cast("long").alias("sign"), F.col("quantity").cast("double").alias("quantity"), (sign * F.col("quantity").cast("double")).alias("signed_quantity"))
    return open_interval_sums(events, t, lookback_us, {"trade_count": "one", "signed_count": "sign", "volume": "quantity", "signed_volume": "signed_quantity"}, bucket_us=bucket_us)
