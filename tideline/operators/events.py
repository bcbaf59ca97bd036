"""Quotes to events: validity, collapse of consecutive equal states, dense ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import DAY_US, all_finite, midprice, relative_spread
from tideline.operators.ordering import bucket_width, dense_ids, previous_row
from tideline.operators.validate import check_quote_order
from tideline.plans.spec import BOOK_STATE

ORDER = ["us", "update_id"]


def valid_quote() -> Column:
    """Finite prices and sizes, bid <= ask, all positive. NaN compares greater in Spark, so finiteness comes first."""
    positive = reduce(lambda x, y: x & y, [F.col(c) > 0 for c in BOOK_STATE])
    return all_finite(*BOOK_STATE) & positive & (F.col("bid_price") <= F.col("ask_price"))


def collapse(quotes: DataFrame, width: int = DAY_US) -> DataFrame:
    """Valid quotes that differ from the valid quote before; invalid ones neither break nor start a run."""
    seen = previous_row(quotes.where(valid_quote()), list(BOOK_STATE), ORDER, width)
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"before.{c}") for c in BOOK_STATE])
    return seen.where(F.col("before").isNull() | ~same).drop("before")


def build_events(quotes: DataFrame, width: int | None = None, check: bool = False) -> DataFrame:
    """event_id, us, update_id, the book's state, midprice, relative_spread.

    ``width`` is that of the time buckets (derived from the number of quotes if not given). With ``check``, quotes must come in source order (raw_row_number), and at least one event must be left.
    """
    if check:
        check_quote_order(quotes)
        if quotes.where(valid_quote()).isEmpty():
            raise ValueError("quotes: no valid quote, so no event")
    width = width or bucket_width(quotes)
    bid, ask = F.col("bid_price"), F.col("ask_price")
    return dense_ids(collapse(quotes, width), ORDER, width=width).select("event_id", "us", "update_id", *BOOK_STATE, midprice(bid, ask).alias("midprice"), relative_spread(bid, ask).alias("relative_spread"))


def build_summary(quotes: DataFrame, events: DataFrame) -> DataFrame:
    """One row: raw, valid, invalid, distinct rows, collapsed rows, their share, first and last time."""
    q = quotes.agg(F.count(F.lit(1)).alias("raw_rows"), F.coalesce(F.sum(valid_quote().cast("long")), F.lit(0)).alias("clean_rows"))
    e = events.agg(F.count(F.lit(1)).alias("event_rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    collapsed = F.col("clean_rows") - F.col("event_rows")
    return q.crossJoin(e).select("raw_rows", "clean_rows", (F.col("raw_rows") - F.col("clean_rows")).alias("invalid_rows"), "event_rows", collapsed.alias("collapsed_rows"), F.when(F.col("clean_rows") > 0, collapsed / F.col("clean_rows")).alias("collapsed_share"), "first_us", "last_us")
