"""Audits that recompute labels, features and trade windows for sampled rows another way, and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import is_close
from tideline.operators.ordering import core, with_halo
from tideline.operators.ranks import RANGES, quantiles


def sample_ids(data: DataFrame, n: int, seed: int = 42, key: str = "event_id", low: int | None = None, high: int | None = None) -> DataFrame:
    """A sample of ``n`` ids without replacement from an id range, the same on every run."""
    d = data if low is None else data.where(F.col(key).between(low, high))
    return d.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def label_alignment(sample: DataFrame, events: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """A row for each sampled row and horizon: its label against the sign of two midprices fetched by key."""
    labels = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_{h}").alias("label")) for h in horizons])
    long = sample.select("event_id", F.explode(labels).alias("r")).select("event_id", "r.*").withColumn("later_id", F.col("event_id") + F.col("horizon"))
    later = events.select(F.col("event_id").alias("later_id"), F.col("midprice").alias("later"))
    now = events.select("event_id", F.col("midprice").alias("now"))
    manual = F.signum(F.col("later") - F.col("now")).cast("int")
    return long.join(now, "event_id").join(later, "later_id").select("event_id", "horizon", "label", manual.alias("manual_label"), (manual == F.col("label")).alias("match"))


def history_features(sample: DataFrame, events: DataFrame, back: int = 20, bucket: int = 65_536) -> DataFrame:
    """mid_return_5 and realized volatility recomputed from each row's history, in double and in float, against the table's.

    The history is an array of the midprices before, from buckets of ids with a halo; rows without one are left out.
    The float version takes logarithms and steps as they would be if the table had been stored and computed in float.
    """
    w = Window.partitionBy("halo").orderBy("event_id").rowsBetween(-back, 0)
    history = core(with_halo(events.select("event_id", "midprice"), "event_id", bucket, back, 0).withColumn("h", F.collect_list("midprice").over(w)), "event_id", bucket).where(F.size("h") > back).select("event_id", "h")

    def recomputed(kind: str) -> tuple[Column, Column]:
        m = F.transform("h", lambda x: F.log(x.cast(kind).cast("double")).cast(kind))
        steps = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: (F.element_at(m, -i) - F.element_at(m, -i - 1)).cast(kind).cast("double"))
        return (F.element_at(m, -1) - F.element_at(m, -6)).cast(kind).cast("double"), F.sqrt(F.aggregate(steps, F.lit(0.0), lambda x, y: x + y * y))

    joined = sample.select("event_id", "mid_return_5", "realized_vol_20").join(history, "event_id")
    ret, vol = recomputed("double")
    ret32, vol32 = recomputed("float")
    stored, volatility = F.col("mid_return_5"), F.col("realized_vol_20")
    return joined.select(
        "event_id", is_close(stored, ret, 1e-9, 1e-15).alias("return_ok"), is_close(volatility, vol, 1e-9, 1e-12).alias("vol_ok"), F.abs(stored - ret).alias("return_error"), F.abs(volatility - vol).alias("vol_error"),
        F.abs(stored - ret32).alias("return_error_float"), F.abs(volatility - vol32).alias("vol_error_float"),
    )


def trade_timing(sample: DataFrame, trades: DataFrame, lookback_us: int) -> DataFrame:
    """Trades inside the open interval and at the event's own time, by a bucketed equi-join on time slices."""
    s = sample.select("event_id", "us", "trade_intensity", F.explode(F.array(F.floor(F.col("us") / lookback_us), F.floor(F.col("us") / lookback_us) - 1)).alias("slice"))
    t = trades.select(F.col("us").alias("t"), F.floor(F.col("us") / lookback_us).alias("slice"))
    near = s.join(t, "slice", "left").where(F.col("t").isNull() | ((F.col("t") > F.col("us") - lookback_us) & (F.col("t") <= F.col("us"))))
    counted = near.groupBy("event_id").agg(F.sum((F.col("t") < F.col("us")).cast("long")).alias("before"), F.sum((F.col("t") == F.col("us")).cast("long")).alias("at"))
    b, a = F.coalesce("before", F.lit(0)), F.coalesce("at", F.lit(0))
    return sample.select("event_id", "trade_intensity").join(counted, "event_id", "left").select("event_id", "trade_intensity", b.alias("trades_before"), a.alias("trades_at_event"), (F.col("trade_intensity") == b).alias("match"))


def spread_relative(test: DataFrame, horizons: tuple[int, ...], ranges: int = RANGES) -> DataFrame:
    """Moves of the midprice against the spread, for five overlapping groups of labels and each horizon; exact quantiles.

    ``test`` has midprice, bid_price, ask_price, y_h and mid_h (the midprice h events later).
    """
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_{h}").alias("y"), (F.col(f"mid_{h}") - F.col("midprice")).alias("move")) for h in horizons])
    tags = F.array(F.lit("all"), F.when(F.col("y") == -1, "down").when(F.col("y") == 0, "unchanged").otherwise("up"), F.when(F.col("y") != 0, "nonzero"))
    x = test.select((F.col("ask_price") - F.col("bid_price")).alias("spread"), F.explode(rows).alias("r")).select("spread", "r.*").select("*", F.explode(tags).alias("label_group")).where("label_group is not null")
    x = x.withColumn("abs_move", F.abs("move")).withColumn("ratio", F.abs("move") / F.col("spread"))
    by = ["horizon", "label_group"]
    share = lambda c: F.avg(c.cast("double"))
    out = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"), share(F.signum("move") == F.col("y")).alias("label_match_share"), F.avg("move").alias("mean_move"),
        *[share(F.col("ratio") >= k).alias(f"share_ge_{k}_spread") for k in (1, 2, 5)], F.avg("abs_move").alias("mean_abs_move"), F.avg("ratio").alias("mean_ratio"),
    )
    wanted = (0.5, 0.75, 0.9, 0.95, 0.99)
    for column, names in (("move", ["median_move"]), ("abs_move", [f"abs_move_q{round(100 * q)}" for q in wanted]), ("ratio", [f"ratio_q{round(100 * q)}" for q in wanted])):
        found = quantiles(x, by, column, wanted[: len(names)], ranges)
        out = out.join(F.broadcast(found.select(*by, *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])), by)  # a row for each horizon and group
    return out


def precision_verdict(history: DataFrame, return_tolerance: float = 1e-6, vol_tolerance: float = 1e-6) -> DataFrame:
    """One row: whether the features equal their recomputation, and the verdict: pass, a warning within tolerances, or failure."""
    worst = history.agg(
        F.count(F.lit(1)).alias("n_rows"), F.bool_and("return_ok").alias("return_match"), F.bool_and("vol_ok").alias("vol_match"),
        *[F.max(c).alias(f"max_{c}") for c in ("return_error", "vol_error", "return_error_float", "vol_error_float")],
    )
    fine = F.col("return_match") & F.col("vol_match")
    near = (F.col("max_return_error") <= return_tolerance) & (F.col("max_vol_error") <= vol_tolerance)
    pick = lambda a, b, c: F.when(fine, a).when(near, b).otherwise(c)
    #: The three states.
    return worst.withColumn("status", pick("pass", "pass_with_precision_warning", "fail_precision_check")).withColumn("severity", pick("none", "warning", "critical"))


def critical_checks(labels: DataFrame, invariants: DataFrame, trades: DataFrame, precision: DataFrame, spans: DataFrame) -> DataFrame:
    """check, passed, critical: the conclusion of all audits, a row each; every input is an audit's table or its one row."""
    parts = [
        ("label_alignment", labels.agg(F.bool_and("match").alias("ok")), True),
        ("split_boundary", invariants.select((F.col("eligibility_identity") & F.col("no_dropped_eligible") & F.col("embargo_kept") & F.col("drops_as_expected")).alias("ok")), True),
        ("trade_flow_timing", trades.agg(F.bool_and("match").alias("ok")), True),
        ("event_range", spans.agg(F.bool_and("follows").alias("ok")), True),
        ("log_feature_precision", precision.select((F.col("severity") != "critical").alias("ok")), True),
        ("log_feature_exact", precision.select((F.col("severity") == "none").alias("ok")), False),
    ]
    return reduce(DataFrame.unionByName, [p.select(F.lit(name).alias("check"), F.coalesce("ok", F.lit(False)).alias("passed"), F.lit(critical).alias("critical")) for name, p, critical in parts])
