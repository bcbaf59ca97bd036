"""Regimes: slices below and above exact training medians, kept unchanged for other splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.metrics import CELLS, aggregate_metrics, confusion, merge, nonzero_metrics
from tideline.operators.ranks import RANGES, quantiles
from tideline.operators.validate import check_numeric

#: Regime name -> feature.
REGIMES = {"spread": "relative_spread", "volatility": "realized_vol_20", "intensity": "trade_intensity"}


def check_regimes(data: DataFrame, regimes: dict[str, str] = REGIMES) -> None:
    """Regime features are there, numeric and finite."""
    check_numeric(data, tuple(regimes.values()), "regimes")


def check_cutoffs(medians: DataFrame, regimes: dict[str, str] = REGIMES) -> None:
    """One finite cutoff for each regime, of its own feature; three rows come to the driver."""
    rows = {r.regime: r for r in medians.select("regime", "feature", "cutoff").collect()}
    wrong = [r for r, f in regimes.items() if r not in rows or rows[r].feature != f or rows[r].cutoff is None or not math.isfinite(rows[r].cutoff)]
    if wrong or len(rows) != len(regimes):
        raise ValueError(f"cutoffs do not fit the regimes: {wrong or sorted(rows)}")


def train_medians(train: DataFrame, regimes: dict[str, str] = REGIMES, ranges: int = RANGES) -> DataFrame:
    """regime, feature, cutoff (mean of the two middle values), n_lower (<=), n_upper (>); exact, from running sums over ranges."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(r).alias("regime"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for r, f in regimes.items()])).alias("r")).select("r.*")
    counts = long.groupBy("regime", "feature", "x").agg(F.count(F.lit(1)).alias("n"))
    cut = F.broadcast(quantiles(long, ["regime", "feature"], "x", (0.5,), ranges).withColumnRenamed("q0", "cutoff"))  # a row for each regime
    lower = F.col("x") <= F.col("cutoff")
    return counts.join(cut, ["regime", "feature"]).groupBy("regime", "feature", "cutoff").agg(F.sum(F.when(lower, F.col("n")).otherwise(0)).alias("n_lower"), F.sum(F.when(~lower, F.col("n")).otherwise(0)).alias("n_upper"))


def slice_rows(predictions: DataFrame, medians: DataFrame, regimes: dict[str, str] = REGIMES) -> DataFrame:
    """A row for each regime: adds regime and side (lower or upper). Medians have one row a regime and are broadcast."""
    wide = medians.groupBy().agg(*[F.max(F.when(F.col("regime") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in regimes])
    sides = F.array(*[F.struct(F.lit(r).alias("regime"), F.when(F.col(f) <= F.col(f"cut_{r}"), "lower").otherwise("upper").alias("side")) for r, f in regimes.items()])
    return predictions.crossJoin(F.broadcast(wide)).select("*", F.explode(sides).alias("x")).select("*", "x.regime", "x.side").drop("x", *[f"cut_{r}" for r in regimes])


def regime_confusion(predictions: DataFrame, medians: DataFrame, keys: list[str], regimes: dict[str, str] = REGIMES) -> DataFrame:
    """Confusion counts by regime side. Rows are counted once, by all sides together; the few counts are then dealt to each regime."""
    wide = medians.groupBy().agg(*[F.max(F.when(F.col("regime") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in regimes])
    sided = predictions.crossJoin(F.broadcast(wide)).withColumns({f"side_{r}": F.when(F.col(f) <= F.col(f"cut_{r}"), "lower").otherwise("upper") for r, f in regimes.items()})
    together = confusion(sided, [*keys, *[f"side_{r}" for r in regimes]])
    sides = F.array(*[F.struct(F.lit(r).alias("regime"), F.col(f"side_{r}").alias("side")) for r in regimes])
    return merge(together.select(*keys, *CELLS, F.explode(sides).alias("x")).select(*keys, *CELLS, "x.*"), [*keys, "regime", "side"])


def regime_metrics(predictions: DataFrame, medians: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics per regime side; slices without rows do not appear."""
    return nonzero_metrics(aggregate_metrics(regime_confusion(predictions, medians, keys)))
