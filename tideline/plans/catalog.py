"""All registered queries of the engine: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import utc_day
from tideline.operators import audit, compare, events, features, figures, metrics, models, probability, quality, regimes, splits, timerange, validate
from tideline.plans import fixtures as fx
from tideline.plans.spec import FEATURES
from tideline.session import table
from tideline.sources import datasets

KEYS = ["model", "horizon", "split"]
H = fx.SPEC.horizons
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles to nine places and floats as doubles, so that two engines' sums compare."""
    return df.select(*[F.round(F.col(f.name), places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "float" else F.col(f.name) for f in df.schema])


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


@query
def quality_quotes_daily(spark, d):
    return quality.quotes_by_day(fx.quotes(spark, d), fx.SPEC)


@query
def quality_trades_daily(spark, d):
    return quality.trades_by_day(fx.raw_trades(spark, d), fx.SPEC)


@query
def quality_report(spark, d):
    report = quality.combine_reports(quality_quotes_daily(spark, d), quality_trades_daily(spark, d), fx.SPEC, fx.START, fx.END)
    return report.select("utc_day", "has_quotes", "has_trades", "quote_rows", "trade_rows", "quote_start_delay", "quote_end_early", "trade_start_delay", "trade_end_early", "invalid_quotes", "invalid_trades", "keep_day", "drop_reason")


@query
def calendar_gap_fill(spark, d):
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    cal = quality.calendar(spark, fx.START - timedelta(days=3000), fx.START - timedelta(days=2900)).withColumnRenamed("utc_day", "day")
    return cal.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n_orders"), F.col("n").isNull().alias("missing"))


@query
def quote_events(spark, d):
    return fx.events(spark, d)


@query
def event_build_summary(spark, d):
    q = fx.quotes(spark, d)
    return events.build_summary(q, events.build_events(q))


@query
def labels(spark, d):
    return features.book_and_labels(fx.events(spark, d), fx.SPEC).select("event_id", *[f"y_{h}" for h in H])


@query
def label_distribution(spark, d):
    return features.label_distribution(features.book_and_labels(fx.events(spark, d), fx.SPEC), H)


@query
def book_features(spark, d):
    return features.book_and_labels(fx.events(spark, d), fx.SPEC).select("event_id", "relative_spread", "queue_imbalance", "log_bid_size", "log_ask_size", "delta_bid_size", "delta_ask_size")


@query
def mid_return_5(spark, d):
    b = features.book_and_labels(fx.events(spark, d), fx.SPEC)
    return b.select("event_id", (F.col("mid_return_5") * 1e6).alias("mid_return_5_ppm"))


@query
def realized_vol_20(spark, d):
    b = features.book_and_labels(fx.events(spark, d), fx.SPEC)
    return b.select("event_id", (F.col("realized_vol_20") * 1e6).alias("realized_vol_20_ppm"))


@query
def trade_flow(spark, d):
    return timerange.trade_flow(fx.events(spark, d), fx.trades(spark, d), fx.SPEC.lookback_us).select("event_id", "trade_count", "signed_count", "volume", "signed_volume")


@query
def feature_completeness(spark, d):
    return fx.features(spark, d).select("event_id", "trade_intensity", "signed_count_imbalance", "signed_volume_imbalance", "has_full_lookback", "feature_complete")


@query
def feature_summary(spark, d):
    s = features.feature_summary(fx.features(spark, d), FEATURES)
    big = F.when(F.col("feature").isin("relative_spread", "mid_return_5", "realized_vol_20"), 1e6).otherwise(1.0)
    return s.select("feature", "n_observed", "n_missing", "missing_share", *[F.round(F.col(c) * big, 6).alias(c) for c in ("min", "max", "mean", "std")])


@query
def chronological_split(spark, d):
    return fx.model_data(spark, d).select("event_id", "split", "is_boundary_drop", "model_eligible")


@query
def boundary_drop(spark, d):
    return fx.model_data(spark, d).where("is_boundary_drop").select("event_id", "split")


@query
def split_summary(spark, d):
    return splits.split_summary(fx.model_data(spark, d), H)


@query
def target_diagnostics(spark, d):
    return splits.target_diagnostics(fx.model_data(spark, d), H)


@query
def target_drift(spark, d):
    return splits.target_drift(splits.target_diagnostics(fx.model_data(spark, d), H))


@query
def split_boundary_audit(spark, d):
    return splits.boundary_audit(fx.model_data(spark, d), fx.SPEC)


@query
def split_invariants(spark, d):
    return splits.invariants(fx.model_data(spark, d), fx.SPEC)


@query
def boundary_scan(spark, d):
    return validate.boundary_scan(fx.model_data(spark, d))


@query
def scaler_stats(spark, d):
    s = models.scaler_stats(fx.eligible(spark, d).where("split = 'train'"), FEATURES)
    big = F.when(F.col("feature").isin("relative_spread", "mid_return_5", "realized_vol_20"), 1e6).otherwise(1.0)
    return s.select("feature", F.round(F.col("mean") * big, 6).alias("mean"), F.round(F.col("scale") * big, 6).alias("scale"))


@query
def score_probabilities(spark, d):
    return fx.scored(spark, d).select("event_id", "horizon", "p_down", "p_unchanged", "p_up")


@query
def argmax_predictions(spark, d):
    return fx.scored(spark, d).select("event_id", "horizon", "y_true", "argmax")


@query
def threshold_predictions(spark, d):
    return fx.scored(spark, d).select("event_id", "horizon", "y_true", fx.thresholded().alias("y_pred"))


@query
def majority_baseline(spark, d):
    return fx.train_majority(fx.eligible(spark, d))


@query
def confusion_counts(spark, d):
    return metrics.confusion_rows(fx.prediction_confusion(spark, d), KEYS)


@query
def confusion_true_normalized(spark, d):
    return metrics.confusion_rows(fx.prediction_confusion(spark, d), KEYS, "true")


@query
def per_class_metrics(spark, d):
    return metrics.per_class(fx.prediction_confusion(spark, d), KEYS)


@query
def class_proportions(spark, d):
    return metrics.class_proportions(fx.prediction_confusion(spark, d), KEYS)


@query
def aggregate_metrics(spark, d):
    return metrics.aggregate_metrics(fx.prediction_confusion(spark, d)).drop(*metrics.CELLS)


@query
def nonzero_subset(spark, d):
    return metrics.nonzero_metrics(fx.prediction_confusion(spark, d)).drop(*metrics.CELLS)


@query
def daily_blocks(spark, d):
    return metrics.daily_blocks(fx.predictions(spark, d), KEYS).select(*KEYS, "utc_day", "n_obs", "accuracy", "macro_f1", "balanced_accuracy")


@query
def daily_stability(spark, d):
    return metrics.daily_stability(metrics.daily_blocks(fx.predictions(spark, d), KEYS), ["model", "horizon"])


def _validation(spark, d):
    return fx.scored(spark, d).where("split = 'validation'")


@query
def roc_auc_ovr(spark, d):
    return probability.auc_and_precision(_validation(spark, d), ["horizon"]).select("horizon", "label", "n_pos", "n_neg", "base_rate", "roc_auc")


@query
def average_precision_ovr(spark, d):
    return probability.auc_and_precision(_validation(spark, d), ["horizon"]).select("horizon", "label", "average_precision")


@query
def lift_table(spark, d):
    return probability.lift_table(_validation(spark, d), ["horizon"])


@query
def probability_by_true_class(spark, d):
    return rounded(probability.probability_by_true_class(_validation(spark, d), ["horizon"]), 7)


@query
def threshold_grid(spark, d):
    g = probability.threshold_grid(_validation(spark, d), ["horizon"])
    return g.select("horizon", "threshold_down", "threshold_up", *metrics.CELLS, "accuracy", "macro_f1", "balanced_accuracy", "nonzero_balanced_accuracy")


@query
def best_thresholds(spark, d):
    g = probability.threshold_grid(_validation(spark, d), ["horizon"])
    both = probability.best_thresholds(g, ["horizon"], "macro_f1").unionByName(probability.best_thresholds(g, ["horizon"], "balanced_accuracy"))
    return both.select("horizon", "selection_metric", "threshold_down", "threshold_up", "macro_f1", "balanced_accuracy", "accuracy", *[f"{kind}_{n}_share" for kind in ("true", "pred") for n in ("down", "unchanged", "up")])


@query
def best_threshold_confusion(spark, d):
    v = _validation(spark, d)
    return probability.best_confusion(v, probability.best_thresholds(probability.threshold_grid(v, ["horizon"]), ["horizon"]), ["horizon"])


@query
def regime_thresholds(spark, d):
    m = regimes.train_medians(fx.eligible(spark, d).where("split = 'train'"))
    return m.select("regime", "feature", F.when(F.col("regime") == "intensity", F.col("cutoff")).otherwise(F.col("cutoff") * 1e6).alias("cutoff_scaled"), "n_lower", "n_upper")


@query
def regime_metrics(spark, d):
    m = regimes.train_medians(fx.eligible(spark, d).where("split = 'train'"))
    return regimes.regime_metrics(fx.predictions(spark, d), m, KEYS).select(*KEYS, "regime", "side", "n_obs", "accuracy", "macro_f1", "balanced_accuracy", "nonzero_n_obs", "nonzero_accuracy")


@query
def regime_recombination(spark, d):
    m = regimes.train_medians(fx.eligible(spark, d).where("split = 'train'"))
    return metrics.recombine(regimes.regime_confusion(fx.predictions(spark, d), m, KEYS), [*KEYS, "regime"], "side")


@query
def metric_reconciliation(spark, d):
    return metrics.reconcile(fx.prediction_confusion(spark, d), KEYS)


def _metrics(spark, d):
    return metrics.aggregate_metrics(fx.prediction_confusion(spark, d))


@query
def validation_comparison(spark, d):
    return compare.comparison(_metrics(spark, d))


@query
def train_validation_comparison(spark, d):
    return compare.comparison(_metrics(spark, d), ("train", "validation"))


@query
def ranking(spark, d):
    return metrics.dense_ranking(rounded(compare.comparison(_metrics(spark, d))), ["horizon"], ["macro_f1", "balanced_accuracy"])


@query
def model_deltas(spark, d):
    c = compare.comparison(_metrics(spark, d))
    return compare.deltas_vs(c, "majority").unionByName(compare.deltas_vs(c, "queue_logistic"))


@query
def signal_decay(spark, d):
    return compare.signal_decay(compare.comparison(_metrics(spark, d)), H)


@query
def confusion_recall(spark, d):
    rows = metrics.confusion_rows(fx.prediction_confusion(spark, d).where("split = 'test'"), KEYS)
    return compare.confusion_recall(rows)


def _coefficients(spark):
    return models.coefficient_table(spark, [m for by in fx.frozen_models().values() for m in by.values()])


@query
def coefficient_interpretation(spark, d):
    return rounded(models.coefficient_interpretation(_coefficients(spark)), 6)


@query
def coefficient_sign_stability(spark, d):
    return models.sign_stability(_coefficients(spark))


@query
def top_asymmetry(spark, d):
    return models.top_asymmetry(models.sign_stability(_coefficients(spark)))


@query
def label_alignment_audit(spark, d):
    return audit.label_alignment(fx.features(spark, d), fx.events(spark, d), H)


def _history(spark, d):
    return audit.history_features(fx.eligible(spark, d), fx.events(spark, d))


@query
def history_audit(spark, d):
    return _history(spark, d).select("event_id", "return_ok", "vol_ok")


@query
def precision_verdict(spark, d):
    return audit.precision_verdict(_history(spark, d)).select("n_rows", "return_match", "vol_match", "status", "severity")


@query
def critical_checks(spark, d):
    labels, timing = label_alignment_audit(spark, d), trade_timing_audit(spark, d)
    return audit.critical_checks(labels, split_invariants(spark, d), timing, audit.precision_verdict(_history(spark, d)), boundary_scan(spark, d))


@query
def trade_timing_audit(spark, d):
    return audit.trade_timing(fx.features(spark, d).select("event_id", "us", "trade_intensity"), fx.trades(spark, d), fx.SPEC.lookback_us)


@query
def spread_relative_summary(spark, d):
    e = fx.events(spark, d).select("event_id", "midprice")
    test = fx.eligible(spark, d).where("split = 'test'")
    for h in H:
        test = test.join(e.select((F.col("event_id") - h).alias("event_id"), F.col("midprice").alias(f"mid_{h}")), "event_id")
    return rounded(audit.spread_relative(test, H), 7)


def _compact(spark, d):
    return fx.compact(fx.eligible(spark, d).where("split = 'test'"))


@query
def compact_predictions(spark, d):
    return _compact(spark, d)


@query
def compact_parity(spark, d):
    """Confusion counts of the compact rows against those of the predictions, by horizon and model."""
    rows = [F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("model"), F.col(f"y_true_h{h}").alias("y_true"), F.col(f"{c}_h{h}").alias("y_pred")) for h in H for m, c in (("full_logistic", "y_pred_argmax"), ("full_thresholded", "y_pred_thresholded"))]
    again = metrics.confusion(_compact(spark, d).select(F.explode(F.array(*rows)).alias("r")).select("r.*"), ["horizon", "model"]).alias("a")
    first = fx.prediction_confusion(spark, d).where("split = 'test'").alias("b")
    same = F.lit(True)
    for c in metrics.CELLS:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return again.join(first, ["horizon", "model"]).select("horizon", "model", sum((F.col(f"a.{c}") for c in metrics.CELLS[1:]), F.col(f"a.{metrics.CELLS[0]}")).alias("n_obs"), same.alias("equal"))


def _when(n: int, r: int, value, column: str):
    """The column, but for the ids with a remainder."""
    return F.when(F.col("event_id") % n == r, value).otherwise(F.col(column)).alias(column)


@query
def quote_violations(spark, d):
    return validate.quote_violations(fx.quotes(spark, d))


@query
def event_violations(spark, d):
    """On events with holes and strange values."""
    e, nan = fx.events(spark, d).where("event_id % 900 != 5"), F.lit(float("nan"))
    us = F.when(F.col("event_id") % 300 == 7, F.lit(None)).when(F.col("event_id") % 300 == 9, F.col("us") - 100_000_000_000).otherwise(F.col("us")).alias("us")
    bid = F.when(F.col("event_id") % 500 == 3, -F.col("bid_price")).when(F.col("event_id") % 500 == 4, nan).otherwise(F.col("bid_price")).alias("bid_price")
    return validate.event_violations(e.select("event_id", us, bid, _when(500, 5, F.lit(1.0), "ask_price"), _when(500, 6, F.lit(None), "bid_size"), _when(500, 8, F.lit(float("inf")), "ask_size")))


@query
def trade_violations(spark, d):
    return validate.trade_violations(fx.raw_trades(spark, d))


@query
def feature_violations(spark, d):
    f = fx.features(spark, d).where("event_id % 900 != 5")
    return validate.feature_violations(f.select("event_id", _when(300, 9, F.col("us") - 100_000_000_000, "us"), _when(700, 11, F.lit(None), "feature_complete"), _when(800, 1, F.lit(2), "y_10"), _when(800, 2, F.lit(None), "y_20"), "y_50"), H)


@query
def model_data_violations(spark, d):
    m = fx.model_data(spark, d)
    return validate.model_data_violations(m.select(_when(400, 1, F.lit("other"), "split"), "feature_complete", "is_boundary_drop", _when(400, 2, ~F.col("model_eligible"), "model_eligible"), *[f"y_{h}" for h in H]), H)


@query
def split_violations(spark, d):
    return validate.split_violations(fx.model_data(spark, d).where("split != 'test'").select("split", _when(100, 3, F.lit(None), "model_eligible")), "train")


@query
def prediction_violations(spark, d):
    p = fx.predictions(spark, d)
    return validate.prediction_violations(p.select("y_true", F.when(F.col("event_id") % 1000 == 1, 2).when(F.col("event_id") % 1000 == 2, F.lit(None)).otherwise(F.col("y_pred")).alias("y_pred")))


@query
def probability_violations(spark, d):
    up = F.when(F.col("event_id") % 777 == 2, F.col("p_up") + 0.5).when(F.col("event_id") % 777 == 3, 1.5).when(F.col("event_id") % 777 == 4, F.lit(None)).otherwise(F.col("p_up")).alias("p_up")
    return validate.probability_violations(fx.scored(spark, d).select(_when(777, 1, F.lit(float("nan")), "p_down"), "p_unchanged", up))


@query
def column_violations(spark, d):
    return validate.column_violations(fx.quotes(spark, d), ("bid_price", "ask_price", "bid_size", "ask_size"))


@query
def window_violations(spark, d):
    """A window that leaves rows outside."""
    return splits.window_violations(fx.features(spark, d), fx.START_US + 3 * 86_400_000_000, fx.START_US + 9 * 86_400_000_000, fx.SPEC)


@query
def feature_report(spark, d):
    return features.feature_report(fx.features(spark, d), H)


@query
def plain_summary(spark, d):
    """The summary that keeps infinities, of columns that hold some (whose deviation is no number)."""
    return features.feature_summary(fx.quotes(spark, d), ("bid_price", "ask_price", "bid_size", "ask_size"), keep_infinite=True).drop("mean", "std")


@query
def metric_bundle(spark, d):
    return metrics.stacked(metrics.evaluation_tables(fx.prediction_confusion(spark, d), KEYS), KEYS)


@query
def validation_bundle(spark, d):
    """The tables of the bundle, each as its number of rows and one sum by horizon."""
    sums = {"auc_average_precision": "roc_auc", "probability_by_true_class": "mean", "lift": "hits", "threshold_grid": "macro_f1", "best_thresholds": "accuracy"}
    out = None
    for name, t in probability.validation_bundle(_validation(spark, d), ["horizon"]).items():
        value = F.col(sums[name]) if name in sums else F.col("n00") + F.col("n11") + F.col("n22")
        part = t.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(value.cast("double")), 6).alias("total")).select(F.lit(name).alias("table"), "horizon", "n_rows", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query
def nonzero_comparison(spark, d):
    return compare.nonzero_comparison(metrics.nonzero_metrics(fx.prediction_confusion(spark, d)))


@query
def split_row_counts(spark, d):
    return splits.row_counts(fx.model_data(spark, d))


@query
def point_lookup(spark, d):
    e = fx.events(spark, d)
    return datasets.by_ids(e, e.where("event_id % 97 = 5").select("event_id")).select("event_id", "us", "midprice")


@query
def calendar_of_events(spark, d):
    """The first rows of a table in order."""
    return datasets.preview(fx.events(spark, d).groupBy(utc_day("us").alias("utc_day")).agg(F.count(F.lit(1)).alias("n")), ["utc_day"], 5)


@query
def figure_drift(spark, d):
    return figures.drift(splits.target_diagnostics(fx.model_data(spark, d), H))


@query
def figure_horizon_performance(spark, d):
    return figures.horizon_performance(_metrics(spark, d))


@query
def figure_recall(spark, d):
    return figures.recall(metrics.per_class(fx.prediction_confusion(spark, d), KEYS))


@query
def figure_regimes(spark, d):
    return figures.regimes(regime_metrics(spark, d))


@query
def figure_nonzero(spark, d):
    return figures.nonzero(metrics.nonzero_metrics(fx.prediction_confusion(spark, d)))


@query
def benchmark_merge(spark, d):
    """Mean times of runs beside the median of their engine."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("engine"), F.col("o_orderstatus").alias("run"), F.col("o_totalprice").alias("seconds"))
    return rounded(compare.benchmark_merge(o), 4)


@query
def id_range_scan(spark, d):
    return datasets.id_range(fx.events(spark, d), 100, 399).select("event_id", "us", "midprice")


@query
def trade_window_scan(spark, d):
    lo, hi = fx.START_US + 5 * 86_400_000_000, fx.START_US + 6 * 86_400_000_000
    return fx.trades(spark, d).where((F.col("us") > lo - fx.SPEC.lookback_us) & (F.col("us") < hi)).select("agg_trade_id", "us", "quantity")


@query
def distinct_days(spark, d):
    return fx.events(spark, d).select(utc_day("us").alias("utc_day")).distinct()


def split_regime(lineitem: DataFrame) -> DataFrame:
    """Split by place in time, training median of a value, then counts and means by split and regime."""
    li = lineitem.select("l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    part = F.when(F.col("l_shipdate") < "1996-01-01", "train").when(F.col("l_shipdate") < "1997-06-01", "validation").otherwise("test")
    # quantities are few distinct numbers, so one aggregate holds them; measured values go through ranks.quantiles
    cut = li.where(F.col("l_shipdate") < "1996-01-01").agg(F.percentile("l_quantity", F.lit(0.5)).alias("cut"))
    sided = li.select(part.alias("split"), "l_quantity", "l_extendedprice", "l_discount").crossJoin(F.broadcast(cut))
    return sided.groupBy("split", F.when(F.col("l_quantity") <= F.col("cut"), "lower").otherwise("upper").alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.avg("l_quantity").alias("mean_quantity"), F.avg("l_discount").alias("mean_discount"))


@query
def split_regime_benchmark(spark, d):
    return split_regime(table(spark, d, "lineitem"))


@query
def label_confusion(spark, d):
    """A binary confusion on the labels table."""
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("n_docs")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    """Fit all features for all horizons on training rows with MLlib, freeze, and list the coefficients."""
    train = fx.eligible(spark, d).where("split = 'train'")
    return models.coefficient_table(spark, [models.fit(train, FEATURES, h, spec_fingerprint=fx.SPEC.fingerprint()) for h in H])


QUERIES["logistic_fit"] = logistic_fit
