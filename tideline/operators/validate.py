"""Checks at the boundaries of stages: one aggregate of violation counters each, raised on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import all_finite, is_finite
from tideline.operators.ordering import previous_row
from tideline.plans.spec import BOOK_STATE, LABELS, SPLITS


def require_columns(df: DataFrame, columns, context: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{context}: missing columns {missing}")
    return df


def counted(df: DataFrame, violations: dict[str, Column], rows: str | None = "n_rows") -> DataFrame:
    """One row with the number of rows that violate each rule (null counts as a violation), from one pass."""
    counts = [F.coalesce(F.sum(F.coalesce(c, F.lit(True)).cast("long")), F.lit(0)).alias(n) for n, c in violations.items()]
    return df.agg(*([F.count(F.lit(1)).alias(rows)] if rows else []), *counts)


def require_clean(violations: DataFrame, context: str, empty_ok: bool = False) -> None:
    """Raise if a row of violation counters has any, or if there were no rows at all."""
    row = violations.first().asDict()
    n = row.pop("n_rows", None)
    bad = {k: v for k, v in row.items() if v}
    if bad or (n == 0 and not empty_ok):
        raise ValueError(f"{context}: {bad or 'no rows'}")


def require_none(df: DataFrame, violations: dict[str, Column], context: str) -> None:
    require_clean(counted(df, violations, None), context)


def quote_violations(quotes: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Source order (raw_row_number): times never fall, ids never fall within a time, neither is null."""
    require_columns(quotes, ["us", "update_id", "raw_row_number", *BOOK_STATE], "quotes")
    seen = previous_row(quotes.select("raw_row_number", "us", "update_id"), ["us", "update_id"], ["raw_row_number"], chunk)
    b = F.col("before")
    back = b.isNotNull() & (F.col("us") < b["us"])
    within = b.isNotNull() & (F.col("us") == b["us"]) & (F.col("update_id") < b["update_id"])
    return counted(seen, {"null_time": F.col("us").isNull(), "null_id": F.col("update_id").isNull(), "time_falls": F.coalesce(back, F.lit(False)), "id_falls": F.coalesce(within, F.lit(False))})


def check_quote_order(quotes: DataFrame) -> None:
    require_clean(quote_violations(quotes), "quotes")


def event_violations(events: DataFrame, zero_based: bool = True, chunk: int = 1_000_000) -> DataFrame:
    """Ids one after the other (from 0 if asked), times never null and never fall, prices and sizes finite and positive, no crossed book."""
    require_columns(events, ["event_id", "us", *BOOK_STATE], "events")
    seen = previous_row(events.select("event_id", "us", *BOOK_STATE), ["event_id", "us"], ["event_id"], chunk)
    b, first = F.col("before"), F.col("before").isNull()
    rules = {
        "null_time": F.col("us").isNull(), "id_gap": ~first & (F.col("event_id") != b["event_id"] + 1), "time_falls": ~first & F.coalesce(F.col("us") < b["us"], F.lit(False)),
        **{f"bad_{c}": ~(is_finite(F.col(c)) & (F.col(c) > 0)) for c in BOOK_STATE}, "crossed": F.coalesce(F.col("ask_price") < F.col("bid_price"), F.lit(False)),
    }
    if zero_based:
        rules["not_from_zero"] = first & (F.col("event_id") != 0)
    return counted(seen, rules)


def check_events(events: DataFrame, zero_based: bool = True) -> None:
    require_clean(event_violations(events, zero_based), "events")


def trade_violations(trades: DataFrame) -> DataFrame:
    require_columns(trades, ["us", "quantity", "buyer_is_maker"], "trades")
    if trades.schema["buyer_is_maker"].dataType.typeName() != "boolean":
        raise TypeError("trades: buyer_is_maker is not boolean")
    return counted(trades, {"null_time": F.col("us").isNull(), "bad_quantity": ~(is_finite(F.col("quantity")) & (F.col("quantity") > 0)), "null_maker": F.col("buyer_is_maker").isNull()})


def check_trades(trades: DataFrame) -> None:
    require_clean(trade_violations(trades), "trades")


def feature_violations(table: DataFrame, horizons: tuple[int, ...], chunk: int = 1_000_000) -> DataFrame:
    """What a table must meet before it is split: ids 0 .. n-1, times in order, flags and labels without null or strange values."""
    require_columns(table, ["event_id", "us", "feature_complete", *[f"y_{h}" for h in horizons]], "features")
    seen = previous_row(table.select("event_id", "us", "feature_complete", *[f"y_{h}" for h in horizons]), ["event_id", "us"], ["event_id"], chunk)
    b, first = F.col("before"), F.col("before").isNull()
    return counted(seen, {
        "id_gap": F.when(first, F.col("event_id") != 0).otherwise(F.col("event_id") != b["event_id"] + 1), "null_time": F.col("us").isNull(), "time_falls": ~first & F.coalesce(F.col("us") < b["us"], F.lit(False)),
        "null_complete": F.col("feature_complete").isNull(), **{f"bad_y_{h}": ~F.col(f"y_{h}").isin(*LABELS) for h in horizons},
    })


def check_features(table: DataFrame, horizons: tuple[int, ...]) -> None:
    require_clean(feature_violations(table, horizons), "features")


def model_data_violations(data: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    require_columns(data, ["split", "feature_complete", "is_boundary_drop", "model_eligible", *[f"y_{h}" for h in horizons]], "model data")
    return counted(data, {"bad_split": ~F.col("split").isin(*SPLITS), "bad_eligible": F.col("model_eligible") != (F.col("feature_complete") & ~F.col("is_boundary_drop")), **{f"bad_y_{h}": ~F.col(f"y_{h}").isin(*LABELS) for h in horizons}})


def check_model_data(data: DataFrame, horizons: tuple[int, ...]) -> None:
    require_clean(model_data_violations(data, horizons), "model data")


def split_violations(data: DataFrame, split: str) -> DataFrame:
    """A loaded split: rows of another split, and eligibility that is null (or not boolean, which is an error at once)."""
    require_columns(data, ["split", "model_eligible"], f"split {split}")
    if data.schema["model_eligible"].dataType.typeName() != "boolean":
        raise TypeError(f"split {split}: model_eligible is not boolean")
    return counted(data, {"other_split": F.col("split") != split, "null_eligible": F.col("model_eligible").isNull()})


def check_split(data: DataFrame, split: str) -> None:
    require_clean(split_violations(data, split), f"split {split}")


def prediction_violations(data: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return counted(data, {"bad_true": ~F.col(y_true).isin(*LABELS), "bad_pred": ~F.col(y_pred).isin(*LABELS)})


def check_predictions(data: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> None:
    require_clean(prediction_violations(data, y_true, y_pred), "predictions")


def probability_violations(data: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Probabilities that are not finite or outside 0 and 1, and rows that do not sum to 1."""
    p = [F.col(c) for c in ("p_down", "p_unchanged", "p_up")]
    outside = ~(all_finite("p_down", "p_unchanged", "p_up") & (F.least(*p) >= 0) & (F.greatest(*p) <= 1))
    return counted(data, {"outside": outside, "wrong_sum": ~(F.abs(p[0] + p[1] + p[2] - 1) <= tolerance)})


def check_probabilities(data: DataFrame, tolerance: float = 1e-6) -> None:
    require_clean(probability_violations(data, tolerance), "probabilities")


NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def column_violations(data: DataFrame, columns: tuple[str, ...], context: str = "columns") -> DataFrame:
    """Values of numeric columns that are null or not finite; no columns, repeated, missing and other ones are errors at once."""
    if not columns or len(set(columns)) != len(columns):
        raise ValueError(f"{context}: columns must be given and unique")
    require_columns(data, columns, context)
    if strange := [c for c in columns if data.schema[c].dataType.typeName() not in NUMERIC]:
        raise TypeError(f"{context}: not numeric: {strange}")
    return counted(data, {f"bad_{c}": ~is_finite(F.col(c)) for c in columns})


def check_numeric(data: DataFrame, columns: tuple[str, ...], context: str = "columns") -> None:
    require_clean(column_violations(data, columns, context), context)


def check_unique(df: DataFrame, keys: list[str], context: str = "table") -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{context}: rows are not unique by {keys}")


def assert_unique(df: DataFrame, keys: list[str], context: str = "table") -> DataFrame:
    """The same rows; when they are read, a key that occurs twice is an error."""
    several = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    fine = F.when(F.col("__several"), F.raise_error(F.lit(f"{context}: rows are not unique by {keys}")).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("__several", several).where(fine).drop("__several")


def boundary_scan(data: DataFrame) -> DataFrame:
    """Per split: rows, first and last id and time (for contiguity checks)."""
    w = Window.orderBy("first_id")  # at most three rows
    spans = data.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return spans.withColumn("follows", F.coalesce(F.col("first_id") == F.lag("last_id").over(w) + 1, F.col("first_id") == 0) & F.coalesce(F.col("first_us") >= F.lag("last_us").over(w), F.lit(True)))
