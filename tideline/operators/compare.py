"""Tables that set models side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ranks import quantiles

METRICS = ("accuracy", "macro_f1", "balanced_accuracy")


def comparison(metrics: DataFrame, splits: tuple[str, ...] = ("validation",)) -> DataFrame:
    return metrics.where(F.col("split").isin(*splits)).select("model", "horizon", "split", "n_obs", *METRICS)


NONZERO = ("nonzero_n_obs", "nonzero_accuracy", "nonzero_macro_f1", "nonzero_balanced_accuracy")


def nonzero_comparison(metrics: DataFrame, splits: tuple[str, ...] = ("validation",)) -> DataFrame:
    """The same for rows whose true class is not 0."""
    return metrics.where(F.col("split").isin(*splits)).select("model", "horizon", "split", *NONZERO)


def benchmark_merge(runs: DataFrame) -> DataFrame:
    """engine, run, seconds (mean of its repetitions) and the median of all repetitions of the engine."""
    medians = quantiles(runs, ["engine"], "seconds", (0.5,)).withColumnRenamed("q0", "median_seconds")
    return runs.groupBy("engine", "run").agg(F.avg("seconds").alias("seconds")).join(F.broadcast(medians), "engine")  # a row for each engine


def deltas_vs(metrics: DataFrame, reference: str) -> DataFrame:
    """Differences of each model's metrics to those of the reference model, by horizon and split."""
    ref = metrics.where(F.col("model") == reference).select("horizon", "split", *[F.col(m).alias(f"ref_{m}") for m in METRICS])
    return metrics.join(F.broadcast(ref), ["horizon", "split"]).select("model", "horizon", "split", F.lit(reference).alias("reference"), *[(F.col(m) - F.col(f"ref_{m}")).alias(f"delta_{m}") for m in METRICS])


def signal_decay(metrics: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Metrics of each model by horizon in columns, and longest minus shortest."""
    wide = metrics.groupBy("model").pivot("horizon", list(horizons)).agg(*[F.first(m).alias(m) for m in METRICS])
    named = wide.select("model", *[F.col(f"{h}_{m}").alias(f"{m}_h{h}") for h in horizons for m in METRICS])
    return named.withColumns({f"{m}_decay": F.col(f"{m}_h{horizons[-1]}") - F.col(f"{m}_h{horizons[0]}") for m in METRICS})


def confusion_recall(rows: DataFrame) -> DataFrame:
    """Recalls from tidy cells (model, horizon, true_label, pred_label, value), and their mean over three classes."""
    wide = rows.groupBy("model", "horizon", "true_label").pivot("pred_label", [-1, 0, 1]).agg(F.sum("value"))
    total = F.col("-1") + F.col("0") + F.col("1")
    own = F.when(F.col("true_label") == -1, F.col("-1")).when(F.col("true_label") == 0, F.col("0")).otherwise(F.col("1"))
    r = wide.select("model", "horizon", "true_label", F.when(total > 0, own / total).otherwise(0.0).alias("recall"))
    by = r.groupBy("model", "horizon").pivot("true_label", [-1, 0, 1]).agg(F.first("recall"))
    return by.select("model", "horizon", F.col("-1").alias("recall_down"), F.col("0").alias("recall_unchanged"), F.col("1").alias("recall_up"), ((F.col("-1") + F.col("0") + F.col("1")) / 3).alias("mean_recall"))
