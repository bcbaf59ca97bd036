"""State that is carried from batch to batch of a stream: collapse of equal quotes, and gaps over the edge of a batch.

State is one small row a key. Rows of a batch are taken in order of time and id; a row that comes in a later batch than a
newer one keeps its place in the stream's order, as event time is not waited for here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalar import utc_day
from tideline.plans.spec import BOOK_STATE

EVENTS = "symbol string, event_id long, us long, update_id long, bid_price double, ask_price double, bid_size double, ask_size double, midprice double"
DAYS = "utc_day date, rows long, invalid_rows long, first_us long, last_us long, max_gap_s double"


def _valid(q: pd.DataFrame) -> np.ndarray:
    values = q[list(BOOK_STATE)].to_numpy(float)
    return np.isfinite(values).all(1) & (values > 0).all(1) & (values[:, 0] <= values[:, 1])


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(["us", "update_id"], kind="stable")


def _collapse(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = tuple(state.get) if state.exists else (0, *[float("nan")] * 4)
    q = _in_order(parts)
    q = q[_valid(q)]
    if not len(q):
        return
    values = q[list(BOOK_STATE)].to_numpy(float)
    before = np.vstack([np.array(held[1:], float)[None], values[:-1]])
    new = (values != before).any(1)  # NaN, before the first row, differs from all
    out = q[new].copy()
    out["symbol"], out["event_id"] = key[0], held[0] + np.arange(int(new.sum()))
    out["midprice"] = (out["bid_price"] + out["ask_price"]) * 0.5
    state.update((held[0] + int(new.sum()), *map(float, values[-1])))
    yield out[["symbol", "event_id", "us", "update_id", *BOOK_STATE, "midprice"]]


def stream_events(quotes: DataFrame) -> DataFrame:
    """Events of a stream of quotes with ``symbol``: ids go on, and a quote is compared with the valid one before, over batches too."""
    state = "next_id long, " + ", ".join(f"{c} double" for c in BOOK_STATE)
    return quotes.select("symbol", "us", "update_id", *BOOK_STATE).groupBy("symbol").applyInPandasWithState(_collapse, EVENTS, state, "append", "NoTimeout")


def _day(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows, invalid, first, last, gap = tuple(state.get) if state.exists else (0, 0, None, None, None)
    q = _in_order(parts)
    us = q["us"].to_numpy()
    seen = us if last is None else np.concatenate([[last], us])
    gaps = np.diff(np.sort(seen)) / 1e6
    if len(gaps):
        gap = float(max(gaps.max(), gap if gap is not None else 0.0))
    rows, invalid = rows + len(q), invalid + int((~_valid(q)).sum())
    first, last = int(us.min() if first is None else min(first, us.min())), int(us.max() if last is None else max(last, us.max()))
    state.update((rows, invalid, first, last, gap))
    yield pd.DataFrame({"utc_day": [key[0]], "rows": [rows], "invalid_rows": [invalid], "first_us": [first], "last_us": [last], "max_gap_s": [gap]})


def stream_quality(quotes: DataFrame) -> DataFrame:
    """The state of each UTC day after every batch that has rows of it: counts, first and last time, greatest gap so far."""
    state = "rows long, invalid_rows long, first_us long, last_us long, max_gap_s double"
    return quotes.select(utc_day("us").alias("utc_day"), "us", "update_id", *BOOK_STATE).groupBy("utc_day").applyInPandasWithState(_day, DAYS, state, "update", "NoTimeout")


def final_days(updates: DataFrame) -> DataFrame:
    """The last state of each day, from all updates that a sink has kept."""
    last = updates.groupBy("utc_day").agg(F.max_by(F.struct(*updates.columns[1:]), "rows").alias("s"))
    return last.select("utc_day", "s.*")
