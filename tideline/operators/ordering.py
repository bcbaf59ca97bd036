"""Global order without a global sort: buckets of time or of ids, and small tables with one row a bucket.

``previous_row`` and ``dense_ids`` window inside time buckets and carry one row, or one count, from bucket to bucket.
``with_halo`` replicates the few rows that a frame reaches over a bucket's edge, so that lags, leads and row frames
over dense ids run as one window partitioned by bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import DAY_US


def time_bucket(us: str, width: int = DAY_US) -> Column:
    return F.floor(F.col(us) / F.lit(width)).cast("long")


#: Rows that a time bucket should hold.
BUCKET_ROWS = 1_000_000


def bucket_width(df: DataFrame, us: str = "us", rows: int = BUCKET_ROWS, least: int = 1) -> int:
    """Microseconds of a time bucket that holds about ``rows`` rows if they are spread evenly, ``least`` or more; one aggregate.

    So the number of tasks follows the number of rows, not that of days.
    """
    r = df.agg(F.count(us).alias("n"), (F.max(us) - F.min(us) + 1).alias("span")).first()
    return max(least, math.ceil(r.span / max(1, math.ceil(r.n / rows)))) if r.n else max(least, DAY_US)


def previous_row(df: DataFrame, columns: list[str], order: list[str], width: int = DAY_US) -> DataFrame:
    """Add ``before``: a struct of ``columns`` of the row before in the order (null for the very first)."""
    row, key = F.struct(*columns), F.struct(*order)
    b = df.withColumn("bucket", time_bucket(order[0], width))
    last = b.groupBy("bucket").agg(F.max_by(row, key).alias("last"))
    carried = last.select("bucket", F.lag("last").over(Window.orderBy("bucket")).alias("carried"))  # one row a bucket
    inside = b.withColumn("near", F.lag(row).over(Window.partitionBy("bucket").orderBy(*order)))
    return inside.join(carried, "bucket").withColumn("before", F.coalesce("near", "carried")).drop("near", "carried", "bucket")


def dense_ids(df: DataFrame, order: list[str], name: str = "event_id", width: int = DAY_US) -> DataFrame:
    """Add 0, 1, 2, ... in the given order: numbers inside a time bucket plus the rows of earlier buckets."""
    b = df.withColumn("bucket", time_bucket(order[0], width))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    local = b.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) - 1)
    return local.join(offsets, "bucket").withColumn(name, (F.col("offset") + F.col("place")).cast("long")).drop("bucket", "offset", "place")


def with_halo(df: DataFrame, key: str, bucket: int, back: int, forward: int) -> DataFrame:
    """Rows with ``halo``: the buckets of ``bucket`` keys in whose frame (``back`` before, ``forward`` after) they lie."""
    k = F.col(key)
    return df.withColumn("halo", F.explode(F.sequence(F.floor((k - forward) / bucket), F.floor((k + back) / bucket))))


def core(df: DataFrame, key: str, bucket: int) -> DataFrame:
    """Only the rows that belong to their bucket themselves."""
    return df.where(F.col("halo") == F.floor(F.col(key) / bucket)).drop("halo")
