"""Daily feed quality: counters, gaps within a day, edges, and a verdict with its reasons."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalar import DAY_US, all_finite, utc_day
from tideline.operators.events import valid_quote
from tideline.operators.ordering import bucket_width, previous_row
from tideline.operators.validate import assert_unique
from tideline.plans.spec import BOOK_STATE, Spec


def _with_gaps(rows: DataFrame) -> DataFrame:
    """Add utc_day and gap: seconds since the row before of the same day, found in time buckets whose number follows the rows'."""
    seen = previous_row(rows, ["us"], ["us"], bucket_width(rows)).withColumn("utc_day", utc_day("us"))
    return seen.withColumn("gap", F.when(utc_day(F.col("before.us")) == F.col("utc_day"), (F.col("us") - F.col("before.us")) / 1e6)).drop("before")


def _total(flag: Column) -> Column:
    return F.sum(F.coalesce(flag, F.lit(False)).cast("long"))


def quotes_by_day(quotes: DataFrame, spec: Spec) -> DataFrame:
    """A row for each UTC day. A gap needs two rows of the day; a day of one row has none.

    Infinite values are compared as numbers are; a comparison with NaN or null holds for none of the counters, and both,
    like infinities, make a quote invalid. (Spark itself takes NaN for the greatest number.)
    """
    numbers = ~F.isnan("bid_price") & ~F.isnan("ask_price")
    return (
        _with_gaps(quotes).groupBy("utc_day")
        .agg(
            F.count(F.lit(1)).alias("quote_rows"), F.min("us").alias("quote_start"), F.max("us").alias("quote_end"), F.max("gap").alias("max_quote_gap"),
            _total(numbers & (F.col("bid_price") > F.col("ask_price"))).alias("crossed"), _total(numbers & (F.col("bid_price") == F.col("ask_price"))).alias("locked"),
            *[_total(F.col(c) <= 0).alias(f"non_positive_{c}") for c in BOOK_STATE], _total(~valid_quote()).alias("invalid_quotes"),
        )
        .withColumn("locked_share", F.col("locked") / F.col("quote_rows"))
        .withColumn("quote_gap_violation", F.coalesce(F.col("max_quote_gap") > spec.max_gap_s, F.lit(False)))
    )


def trades_by_day(trades: DataFrame, spec: Spec) -> DataFrame:
    finite = all_finite("price", "quantity")
    bad = ~finite | (F.col("price") <= 0) | (F.col("quantity") <= 0) | F.col("buyer_is_maker").isNull()
    return (
        _with_gaps(trades).groupBy("utc_day")
        .agg(
            F.count(F.lit(1)).alias("trade_rows"), F.min("us").alias("trade_start"), F.max("us").alias("trade_end"), F.max("gap").alias("max_trade_gap"),
            _total(F.col("price") <= 0).alias("non_positive_price"), _total(F.col("quantity") <= 0).alias("non_positive_quantity"),
            _total(F.col("buyer_is_maker").isNull()).alias("missing_maker"), _total(bad).alias("invalid_trades"),
        )
        .withColumn("trade_gap_violation", F.coalesce(F.col("max_trade_gap") > spec.max_gap_s, F.lit(False)))
    )


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """utc_day from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("utc_day"))


def combine_reports(quotes: DataFrame, trades: DataFrame, spec: Spec, start: date | None = None, end: date | None = None) -> DataFrame:
    """Both feeds by day, over an expected calendar if given; verdict ``keep_day`` and its ``drop_reason``.

    A missing feed and an unknown gap are violations; edges count from midnight to midnight.
    """
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    quotes, trades = assert_unique(quotes, ["utc_day"], "quotes by day"), assert_unique(trades, ["utc_day"], "trades by day")
    both = quotes.join(trades, "utc_day", "full_outer")
    if start is not None:
        both = calendar(quotes.sparkSession, start, end).join(both, "utc_day", "left")
    midnight = F.unix_date("utc_day").cast("long") * DAY_US
    for feed in ("quote", "trade"):
        has = F.coalesce(F.col(f"{feed}_rows"), F.lit(0)) > 0
        late, early = (F.col(f"{feed}_start") - midnight) / 1e6, (midnight + DAY_US - F.col(f"{feed}_end")) / 1e6
        both = (
            both.withColumn(f"has_{feed}s", has).withColumn(f"{feed}_start_delay", late).withColumn(f"{feed}_end_early", early)
            .withColumn(f"{feed}_edge_violation", ~has | F.coalesce((late > spec.max_edge_s) | (early > spec.max_edge_s), F.lit(False)))
            .withColumn(f"{feed}_gap_violation", F.coalesce(F.col(f"{feed}_gap_violation"), F.lit(True)))
            .withColumn(f"invalid_{feed}s", F.coalesce(F.col(f"invalid_{feed}s"), F.lit(0)))
        )
    #: The reasons, in this order.
    reasons = [
        (~F.col("has_quotes"), "missing_quote_data;"),
        (~F.col("has_trades"), "missing_trade_data;"),
        (F.col("quote_gap_violation"), "quote_gap_gt_60s;"),
        (F.col("trade_gap_violation"), "trade_gap_gt_60s;"),
        (F.col("quote_edge_violation"), "quote_day_edge_gap;"),
        (F.col("trade_edge_violation"), "trade_day_edge_gap;"),
        (F.col("invalid_quotes") > 0, "invalid_quotes;"),
        (F.col("invalid_trades") > 0, "invalid_trades;"),
    ]
    text = F.concat(*[F.when(c, r).otherwise("") for c, r in reasons])
    return both.withColumn("keep_day", text == "").withColumn("drop_reason", F.when(text == "", "keep").otherwise(text))


def require_kept(report: DataFrame) -> None:
    """The gate before building events: every day must be kept."""
    bad = report.where(~F.col("keep_day")).select("utc_day", "drop_reason").limit(5).collect()
    if bad:
        raise ValueError("days that fail: " + ", ".join(f"{r.utc_day} ({r.drop_reason})" for r in bad))
