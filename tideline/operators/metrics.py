"""Ternary metrics as algebra over nine confusion counts, which merge by addition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import safe_ratio, utc_day
from tideline.plans.spec import LABELS

CELLS = [f"n{t}{p}" for t in range(3) for p in range(3)]  # true class, predicted class, in the order -1, 0, 1


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns)


def cell(t: int, p: int) -> Column:
    return F.col(f"n{t}{p}")


def true_n(t: int) -> Column:
    return _sum([cell(t, p) for p in range(3)])


def pred_n(p: int) -> Column:
    return _sum([cell(t, p) for t in range(3)])


def n_obs() -> Column:
    return _sum([F.col(c) for c in CELLS])


def confusion(predictions: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Keys and nine counts; partial sums on the map side make any number of rows one row a key and task."""
    counts = [F.sum(((F.col(y_true) == t) & (F.col(y_pred) == p)).cast("long")).alias(f"n{i}{j}") for i, t in enumerate(LABELS) for j, p in enumerate(LABELS)]
    return predictions.groupBy(*keys).agg(*counts)


def precision(c: int) -> Column:
    return safe_ratio(cell(c, c), pred_n(c))


def recall(c: int) -> Column:
    return safe_ratio(cell(c, c), true_n(c))


def f1(c: int) -> Column:
    return safe_ratio(2 * cell(c, c), true_n(c) + pred_n(c))


def observed_mean(values: list[Column], seen: list[Column]) -> Column:
    """Mean over classes that occur; null if none does."""
    return safe_ratio(_sum([F.when(s, v).otherwise(0.0) for v, s in zip(values, seen, strict=True)]), _sum([s.cast("int") for s in seen]), None)


def balanced_accuracy() -> Column:
    return observed_mean([recall(c) for c in range(3)], [true_n(c) > 0 for c in range(3)])


def accuracy() -> Column:
    return safe_ratio(cell(0, 0) + cell(1, 1) + cell(2, 2), n_obs(), None)


def macro_f1() -> Column:
    return (f1(0) + f1(1) + f1(2)) / 3


def aggregate_metrics(wide: DataFrame) -> DataFrame:
    """Adds n_obs, accuracy, macro_f1, balanced_accuracy and the shares of true and predicted classes."""
    names = ("down", "unchanged", "up")
    shares = {f"{kind}_{name}_share": safe_ratio(f(i), n_obs()) for kind, f in (("true", true_n), ("pred", pred_n)) for i, name in enumerate(names)}
    return wide.withColumns({"n_obs": n_obs(), "accuracy": accuracy(), "macro_f1": macro_f1(), "balanced_accuracy": balanced_accuracy(), **shares})


def nonzero_metrics(wide: DataFrame) -> DataFrame:
    """Metrics over rows whose true class is not 0; macro F1 still over three classes; null without rows."""
    n = true_n(0) + true_n(2)
    pred = [cell(0, p) + cell(2, p) for p in range(3)]
    f1_down, f1_up = safe_ratio(2 * cell(0, 0), true_n(0) + pred[0]), safe_ratio(2 * cell(2, 2), true_n(2) + pred[2])
    balanced = observed_mean([recall(0), recall(2)], [true_n(0) > 0, true_n(2) > 0])
    return wide.withColumns({
        "nonzero_n_obs": n, "nonzero_accuracy": safe_ratio(cell(0, 0) + cell(2, 2), n, None), "nonzero_macro_f1": F.when(n > 0, (f1_down + f1_up) / 3), "nonzero_balanced_accuracy": balanced,
        "nonzero_pred_unchanged_share": safe_ratio(pred[1], n, None),
    })


def _explode_rows(wide: DataFrame, keys: list[str], rows: list[Column]) -> DataFrame:
    return wide.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def confusion_rows(wide: DataFrame, keys: list[str], normalize: str | None = None) -> DataFrame:
    """Tidy cells; normalize is None, 'true', 'pred' or 'all'."""

    def value(t: int, p: int) -> Column:
        n = cell(t, p)
        return n if normalize is None else safe_ratio(n, {"true": true_n(t), "pred": pred_n(p), "all": n_obs()}[normalize])

    return _explode_rows(wide, keys, [F.struct(F.lit(a).alias("true_label"), F.lit(b).alias("pred_label"), value(i, j).alias("value")) for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)])


def per_class(wide: DataFrame, keys: list[str]) -> DataFrame:
    return _explode_rows(wide, keys, [F.struct(F.lit(a).alias("label"), precision(i).alias("precision"), recall(i).alias("recall"), f1(i).alias("f1"), true_n(i).alias("support")) for i, a in enumerate(LABELS)])


def class_proportions(wide: DataFrame, keys: list[str]) -> DataFrame:
    return _explode_rows(wide, keys, [F.struct(F.lit(a).alias("label"), true_n(i).alias("n"), safe_ratio(true_n(i), n_obs()).alias("proportion")) for i, a in enumerate(LABELS)])


def daily_blocks(predictions: DataFrame, keys: list[str], us: str = "us") -> DataFrame:
    """Aggregate metrics by UTC day."""
    return aggregate_metrics(confusion(predictions.withColumn("utc_day", utc_day(us)), [*keys, "utc_day"]))


def daily_stability(daily: DataFrame, keys: list[str]) -> DataFrame:
    return daily.groupBy(*keys).agg(F.countDistinct("utc_day").alias("n_days"), *[f(m).alias(f"{n}_{m}") for m in ("accuracy", "macro_f1", "balanced_accuracy") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of confusion counts that were made apart."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in CELLS])


def evaluation_tables(wide: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """All tables that describe predictions, from their confusion counts alone."""
    return {
        "aggregate": aggregate_metrics(wide).drop(*CELLS), "class_proportions": class_proportions(wide, keys), "per_class": per_class(wide, keys), "confusion_counts": confusion_rows(wide, keys),
        "confusion_true_normalized": confusion_rows(wide, keys, "true"), "nonzero_subset": nonzero_metrics(wide).drop(*CELLS),
    }


def stacked(tables: dict[str, DataFrame], keys: list[str], labels: tuple[str, ...] = ("label", "true_label", "pred_label")) -> DataFrame:
    """The tables under each other: table, keys, label columns (null where a table has none), metric, value."""
    out = []
    for name, t in tables.items():
        values = [c for c in t.columns if c not in keys and c not in labels]
        rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])
        marks = [(F.col(c) if c in t.columns else F.lit(None)).cast("int").alias(c) for c in labels]
        out.append(t.select(F.lit(name).alias("table"), *keys, *marks, F.explode(rows).alias("r")).select("table", *keys, *labels, "r.*"))
    return reduce(DataFrame.unionByName, out)


def majority_class(counts: list[Column]) -> Column:
    """The label of the greatest count; the first of -1, 0, 1 on ties."""
    top = F.greatest(*counts)
    return F.when(counts[0] == top, -1).when(counts[1] == top, 0).otherwise(1)


def majority_by_horizon(train: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """horizon, majority: the most frequent label of the rows; one pass, a row for each horizon."""
    counts = [F.sum((F.col(f"y_{h}") == v).cast("long")).alias(f"c{h}_{i}") for h in horizons for i, v in enumerate(LABELS)]
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), majority_class([F.col(f"c{h}_{i}") for i in range(3)]).alias("majority")) for h in horizons])
    return train.agg(*counts).select(F.explode(rows).alias("r")).select("r.*")


def reconcile(wide: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Metrics rebuilt another way, from tidy rows of cells and classes, against those from counts."""
    cells, classes = confusion_rows(wide, keys), per_class(wide, keys)
    hit = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("value")).otherwise(0))
    one = cells.groupBy(*keys).agg(F.sum("value").alias("n"), (hit / F.sum("value")).alias("accuracy_again"))
    two = classes.groupBy(*keys).agg(F.avg("f1").alias("f1_again"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_again"))
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.col(a).isNull() & F.col(b).isNull())
    return aggregate_metrics(wide).join(one, keys).join(two, keys).select(
        *keys, F.col("n").alias("n_obs"), near("accuracy_again", "accuracy").alias("accuracy_ok"), near("f1_again", "macro_f1").alias("macro_f1_ok"), near("balanced_again", "balanced_accuracy").alias("balanced_accuracy_ok"), (F.col("n") == F.col("n_obs")).alias("count_ok")
    )


def recombine(parts: DataFrame, keys: list[str], slices: str) -> DataFrame:
    """Weighted accuracy over the slices of a variable, to be compared with the whole."""
    w = aggregate_metrics(parts).groupBy(*keys).agg(F.count(slices).alias("n_slices"), F.sum("n_obs").alias("n_obs"), (F.sum(F.col("accuracy") * F.col("n_obs")) / F.sum("n_obs")).alias("accuracy"))
    return w


def dense_ranking(metrics: DataFrame, partition: list[str], by: list[str]) -> DataFrame:
    """rank_<metric>: dense rank, greatest first."""
    return metrics.withColumns({f"rank_{m}": F.dense_rank().over(Window.partitionBy(*partition).orderBy(F.col(m).desc())) for m in by})
