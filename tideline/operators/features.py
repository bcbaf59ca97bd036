"""Features and labels of dense events; one bucketed window with a halo gives all lags, leads and row frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import is_finite, queue_imbalance, relative_spread_f32, signed_imbalance
from tideline.operators.ordering import core, with_halo
from tideline.operators.timerange import trade_flow
from tideline.operators.validate import check_events, check_trades
from tideline.plans.spec import LABELS, Spec

VOL_WINDOW, RETURN_LAG = 20, 5
BUCKET = 65_536
FLOAT_FEATURES = ("relative_spread", "queue_imbalance", "log_bid_size", "log_ask_size", "delta_bid_size", "delta_ask_size", "mid_return_5", "realized_vol_20", "signed_count_imbalance", "signed_volume_imbalance")


def book_and_labels(events: DataFrame, spec: Spec, bucket: int = BUCKET) -> DataFrame:
    """Book features and labels y_h = sign(mid at t+h - mid at t); rows without the longest future go for all horizons."""
    longest = max(spec.horizons)
    w = Window.partitionBy("halo").orderBy("event_id")
    mid, log_mid = F.col("midprice"), F.log("midprice")
    halo = with_halo(events, "event_id", bucket, VOL_WINDOW + 1, longest)
    step = halo.withColumn("log_step", log_mid - F.lag(log_mid, 1).over(w))
    wide = step.select(
        "*",
        (F.col("bid_size") - F.lag("bid_size", 1).over(w)).cast("float").alias("delta_bid_size"),
        (F.col("ask_size") - F.lag("ask_size", 1).over(w)).cast("float").alias("delta_ask_size"),
        (log_mid - F.lag(log_mid, RETURN_LAG).over(w)).alias("mid_return_5"),
        F.when(F.col("event_id") >= VOL_WINDOW, F.sqrt(F.sum(F.col("log_step") * F.col("log_step")).over(w.rowsBetween(1 - VOL_WINDOW, 0)))).alias("realized_vol_20"),
        *[F.signum(F.lead("midprice", h).over(w) - mid).cast("int").alias(f"y_{h}") for h in spec.horizons],
    )
    labels = [f"y_{h}" for h in spec.horizons]
    return (
        core(wide, "event_id", bucket).where(F.col(f"y_{longest}").isNotNull())
        .select(
            "event_id", "us", "midprice", "bid_price", "ask_price",
            relative_spread_f32(F.col("bid_price"), F.col("ask_price"), mid).alias("relative_spread"), queue_imbalance(F.col("bid_size"), F.col("ask_size")).alias("queue_imbalance"),
            F.log1p(F.col("bid_size").cast("double")).cast("float").alias("log_bid_size"), F.log1p(F.col("ask_size").cast("double")).cast("float").alias("log_ask_size"),
            "delta_bid_size", "delta_ask_size", "mid_return_5", "realized_vol_20", *labels,
        )
    )


def flow_features(events: DataFrame, trades: DataFrame, spec: Spec, bucket_us: int | None = None) -> DataFrame:
    """event_id, trade_intensity, both imbalances, has_full_lookback (against the first trade of all)."""
    flow = trade_flow(events.select("event_id", "us"), trades, spec.lookback_us, bucket_us)
    first = trades.agg(F.min("us").alias("first_trade"))  # one row
    return flow.crossJoin(F.broadcast(first)).select(
        "event_id", F.col("trade_count").cast("int").alias("trade_intensity"), signed_imbalance(F.col("signed_count"), F.col("trade_count")).alias("signed_count_imbalance"),
        signed_imbalance(F.col("signed_volume"), F.col("volume")).alias("signed_volume_imbalance"), F.coalesce(F.col("us") - spec.lookback_us >= F.col("first_trade"), F.lit(False)).alias("has_full_lookback"),
    )


def build_features(events: DataFrame, trades: DataFrame, spec: Spec, bucket: int = BUCKET, check: bool = True) -> DataFrame:
    """The feature table: ids, time, eleven features, labels, has_full_lookback, feature_complete. Events and trades are checked first."""
    if check:
        check_events(events)
        check_trades(trades)
    joined = book_and_labels(events, spec, bucket).join(flow_features(events, trades, spec), "event_id")
    complete = F.col("has_full_lookback") & reduce(lambda x, y: x & y, [is_finite(F.col(c)) for c in FLOAT_FEATURES])
    return joined.withColumn("feature_complete", complete)


def label_distribution(labelled: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """horizon, label, n, proportion, with zeros for labels that do not occur; one row a pair, one pass."""
    counts = [F.sum((F.col(f"y_{h}") == v).cast("long")).alias(f"n_{h}_{i}") for h in horizons for i, v in enumerate(LABELS)]
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(v).alias("label"), F.coalesce(F.col(f"n_{h}_{i}"), F.lit(0)).alias("n")) for h in horizons for i, v in enumerate(LABELS)])
    total = F.sum("n").over(Window.partitionBy("horizon"))
    return labelled.agg(*counts).select(F.explode(rows).alias("r")).select("r.*").withColumn("proportion", F.when(total > 0, F.col("n") / total))


def feature_summary(features: DataFrame, names: tuple[str, ...], keep_infinite: bool = False) -> DataFrame:
    """Per feature: observed, missing, share missing, min, max, mean, sample deviation. One pass over wide rows.

    Null and NaN are missing; infinities are too, unless they are kept: then they count as the numbers they are, and the
    deviation of a feature that holds one is NaN.
    """
    held = (lambda c: c.isNotNull() & ~F.isnan(c)) if keep_infinite else is_finite
    clean = features.select(*[F.when(held(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in names])
    one = clean.agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{c}__{n}") for c in names for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("mean", F.avg), ("sd", F.stddev_samp))])
    missing = lambda c: F.col("rows") - F.col(f"{c}__n")
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__n").alias("n_observed"), missing(c).alias("n_missing"), F.when(F.col("rows") > 0, missing(c) / F.col("rows")).alias("missing_share"), F.col(f"{c}__lo").alias("min"), F.col(f"{c}__hi").alias("max"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__sd").alias("std")) for c in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def feature_report(features: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """One row: rows, complete rows, rows with a full lookback, first and last id and time, labels by horizon."""
    counts = [F.sum((F.col(f"y_{h}") == v).cast("long")).alias(f"y_{h}_{n}") for h in horizons for v, n in zip(LABELS, ("down", "unchanged", "up"), strict=True)]
    return features.agg(F.count(F.lit(1)).alias("rows_total"), *[F.sum(F.col(c).cast("long")).alias(f"{c}_rows") for c in ("feature_complete", "has_full_lookback")], F.min("event_id").alias("first_event_id"), F.max("event_id").alias("last_event_id"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), *counts)
