"""The numbers behind the five figures, as tidy rows: filtered, reshaped and in a fixed order when they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tidy(rows: DataFrame, keys: list[str], name: str, values: dict[str, str]) -> DataFrame:
    """A row for each of the columns ``values`` (column -> its name in the figure)."""
    parts = F.array(*[F.struct(F.lit(n).alias(name), F.col(c).alias("value")) for c, n in values.items()])
    return rows.select(*keys, F.explode(parts).alias("r")).select(*keys, "r.*")


def drift(diagnostics: DataFrame) -> DataFrame:
    """Share of non-zero labels by horizon and split."""
    return diagnostics.select("horizon", "split", F.col("nonzero_share").alias("value"))


def horizon_performance(metrics: DataFrame, split: str = "test") -> DataFrame:
    """Macro F1 and balanced accuracy by model and horizon."""
    return _tidy(metrics.where(F.col("split") == split), ["model", "horizon"], "metric", {"macro_f1": "macro_f1", "balanced_accuracy": "balanced_accuracy"})


def recall(per_class: DataFrame, split: str = "test") -> DataFrame:
    """Recall of each class by model and horizon."""
    name = F.when(F.col("label") == -1, "down").when(F.col("label") == 0, "unchanged").otherwise("up")
    return per_class.where(F.col("split") == split).select("model", "horizon", name.alias("label"), F.col("recall").alias("value"))


def regimes(metrics: DataFrame, split: str = "test") -> DataFrame:
    """Macro F1 below and above each cutoff."""
    return metrics.where(F.col("split") == split).select("model", "horizon", "regime", "side", F.col("macro_f1").alias("value"))


def nonzero(metrics: DataFrame, split: str = "test") -> DataFrame:
    """Balanced accuracy where the label is not 0."""
    return metrics.where(F.col("split") == split).select("model", "horizon", F.col("nonzero_balanced_accuracy").alias("value"))
