"""A deterministic projection of the test table ``events`` into quotes and trades, and the experiment run on it."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalar import all_finite, argmax_label, micros, threshold_label, window_us
from tideline.operators.events import build_events
from tideline.operators.features import build_features
from tideline.operators.metrics import confusion, majority_by_horizon
from tideline.operators.models import FrozenModel, logits_by_horizon, softmax_columns
from tideline.operators.splits import assign_splits
from tideline.plans.spec import FEATURES, LABELS, SPLITS, Spec
from tideline.session import table
from tideline.sources.staging import staged

SPEC = Spec(lookback_us=30 * 60 * 1_000_000, max_gap_s=900.0, max_edge_s=900.0)
START, END = date(2024, 1, 1), date(2024, 1, 31)
START_US, END_US = window_us(START, END - timedelta(days=1))  # the last day of the calendar has no rows
#: Frozen thresholds (down, up) of the demonstration models.
THRESHOLDS = {10: (0.35, 0.35), 20: (0.375, 0.375), 50: (0.4, 0.4)}


def _named(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, by a generator of one row: filters on them do not pass it, so no mention of one in a filter computes it anew.

    Else the filter on valid quotes, say, holds each column's whole rule dozens of times, in code too large for the JIT compiler.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _cents(e: DataFrame) -> DataFrame:
    return _named(e, ["event_id", "user_id", "event_type"], us=micros("ts"), c=F.round(F.col("value") * 100).cast("long"))


def _odd(c: Column, *cases: tuple[int, Column]) -> Column:
    """``c``, but for the rows whose cents are divisible by a number: strange values that feeds have."""
    out = c
    for n, value in cases:
        out = F.when(F.col("c") % n == 0, value).otherwise(out)
    return out


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with crossed, NaN, infinite and null ones among them."""
    nan, inf, null = F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("double")
    step = F.when(F.col("c") % 97 == 0, -1).otherwise(1 + F.col("user_id") % 2)
    return _named(
        _cents(table(spark, sf_dir, "events")), ["us", "event_id"],
        bid_price=_odd((6000000 + F.col("c") % 3).cast("double") / 100, (211, nan), (223, -inf)), ask_price=_odd((6000000 + F.col("c") % 3 + step).cast("double") / 100, (227, inf), (229, nan)),
        bid_size=_odd((1 + F.col("c") % 2).cast("double"), (233, null), (239, F.lit(0.0))), ask_size=_odd((1 + F.col("user_id") % 2).cast("double"), (241, F.lit(-1.0)), (251, -inf)),
    ).select("us", F.col("event_id").alias("update_id"), "bid_price", "ask_price", "bid_size", "ask_size", F.col("event_id").alias("raw_row_number"))


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with strange values among them."""
    maker = F.when(F.col("c") % 211 != 0, F.col("user_id") % 2 == 0)
    rows = _cents(table(spark, sf_dir, "events")).where(F.col("event_type").isin("purchase", "click"))
    return _named(
        rows, ["us", "event_id"],
        price=_odd((6000000 + F.col("c") % 3).cast("double") / 100, (223, F.lit(float("inf"))), (227, F.lit(0.0))), quantity=_odd(F.col("c").cast("double"), (229, F.lit(float("-inf"))), (233, F.lit(float("nan")))), buyer_is_maker=maker,
    ).select("us", F.col("event_id").alias("agg_trade_id"), "price", "quantity", "buyer_is_maker")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades that features are made of: the valid ones."""
    return raw_trades(spark, sf_dir).where(all_finite("price", "quantity") & (F.col("price") > 0) & (F.col("quantity") > 0) & F.col("buyer_is_maker").isNotNull())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "events", sf_dir, lambda: build_events(quotes(spark, sf_dir)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "features", sf_dir, lambda: build_features(events(spark, sf_dir), trades(spark, sf_dir), SPEC))


def model_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "model-data", sf_dir, lambda: assign_splits(features(spark, sf_dir), START_US, END_US, SPEC))


def frozen_models() -> dict[str, dict[int, FrozenModel]]:
    """Demonstration coefficients, from a rule: any fixed numbers show scoring, none are fitted."""
    scales = (1e-7, 0.25, 0.2, 0.2, 0.7, 0.7, 1e-7, 5e-7, 2.0, 0.8, 0.8)
    out: dict[str, dict[int, FrozenModel]] = {"queue_logistic": {}, "full_logistic": {}}
    for h in SPEC.horizons:
        g = 1 + h / 50
        out["queue_logistic"][h] = FrozenModel("queue_logistic", h, ("queue_imbalance",), (0.0,), (0.25,), ((-0.2 * g,), (0.05,), (0.15 * g,)), (0.1, -0.3, 0.05))
        rows = tuple(tuple(round(s * (0.4 - 0.07 * i) * g / (1 + i % 3), 4) for i in range(len(FEATURES))) for s in (-1.0, 0.2, 0.8))
        out["full_logistic"][h] = FrozenModel("full_logistic", h, FEATURES, (1.67e-6 * 0.5, *([0.0] * 10)), tuple(max(s, 1e-9) for s in scales), rows, (0.15, -0.35, 0.1))
    return out


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_data(spark, sf_dir).where("model_eligible")


def scored(spark: SparkSession, sf_dir: str, name: str = "full_logistic") -> DataFrame:
    """Scores of all eligible rows, as a stage."""
    return staged(spark, f"scores-{name}", sf_dir, lambda: score_rows(eligible(spark, sf_dir), name))


def score_rows(base: DataFrame, name: str, decimals: int = 9) -> DataFrame:
    """A row for each horizon: y_true, probabilities (rounded, so that engines agree), argmax."""
    keep = ["event_id", "us", "split", "relative_spread", "realized_vol_20", "trade_intensity"]
    # each later step names its result, so that no expression is computed twice
    long = logits_by_horizon(base, frozen_models()[name], keep)
    long = softmax_columns(long, ["z0", "z1", "z2"], ["p_down", "p_unchanged", "p_up"], decimals)
    top = F.greatest("p_down", "p_unchanged", "p_up")
    return long.withColumn("argmax", F.when(F.col("p_down") == top, LABELS[0]).when(F.col("p_unchanged") == top, LABELS[1]).otherwise(LABELS[2]))


def train_majority(data: DataFrame) -> DataFrame:
    """horizon, majority: the most frequent training label; three rows."""
    return majority_by_horizon(data.where(F.col("split") == SPLITS[0]), SPEC.horizons)


def compact(base: DataFrame, decimals: int | None = 9) -> DataFrame:
    """Test predictions of the full model, a row each: ids, diagnostics, and six columns a horizon. No row is multiplied."""
    out = base
    for h in SPEC.horizons:
        z = frozen_models()["full_logistic"][h].logits()
        names = [f"proba_{n}_h{h}" for n in ("down", "unchanged", "up")]
        out = softmax_columns(out.withColumns({f"z{i}": x for i, x in enumerate(z)}), ["z0", "z1", "z2"], names, decimals)
        p = [F.col(n) for n in names]
        out = out.withColumns({f"y_true_h{h}": F.col(f"y_{h}"), f"y_pred_argmax_h{h}": argmax_label(p, LABELS), f"y_pred_thresholded_h{h}": threshold_label(p[0], p[2], *THRESHOLDS[h])})
    six = [f"{c}_h{h}" for h in SPEC.horizons for c in ("y_true", "y_pred_argmax", "y_pred_thresholded", "proba_down", "proba_unchanged", "proba_up")]
    return out.select("event_id", "us", F.col("relative_spread").cast("float").alias("relative_spread"), F.col("realized_vol_20").cast("float").alias("realized_vol_20"), "trade_intensity", *six)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all models, as a stage."""
    return staged(spark, "predictions", sf_dir, lambda: predict_all(spark, sf_dir))


ROW = ["event_id", "us", "split", "relative_spread", "realized_vol_20", "trade_intensity", "horizon", "y_true"]


def thresholded() -> Column:
    """The label that the horizon's frozen thresholds give a row of scores."""
    t_down, t_up = (F.element_at(F.create_map(*[x for h, t in THRESHOLDS.items() for x in (F.lit(h), F.lit(t[side]))]), F.col("horizon")) for side in (0, 1))
    return threshold_label(F.col("p_down"), F.col("p_up"), t_down, t_up)


def predict_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, horizon, split, event_id, us, regime features, y_true, y_pred for four models; one pass scores all."""
    base = eligible(spark, sf_dir)
    full = scored(spark, sf_dir, "full_logistic")
    two = full.select(*ROW, F.explode(F.array(F.struct(F.lit("full_logistic").alias("model"), F.col("argmax").alias("y_pred")), F.struct(F.lit("full_thresholded").alias("model"), thresholded().alias("y_pred")))).alias("m")).select(*ROW, "m.*")
    queue = scored(spark, sf_dir, "queue_logistic").select(*ROW, F.lit("queue_logistic").alias("model"), F.col("argmax").alias("y_pred"))
    most = full.select(*ROW).join(F.broadcast(train_majority(base)), "horizon").select(*ROW, F.lit("majority").alias("model"), F.col("majority").alias("y_pred"))
    return two.unionByName(queue).unionByName(most)


def prediction_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine counts for each model, horizon and split, as a stage of its own: counted where the predictions arise, which need not be written for it."""
    return staged(spark, "confusion", sf_dir, lambda: confusion(predict_all(spark, sf_dir), ["model", "horizon", "split"]))
