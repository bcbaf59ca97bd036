"""Probability diagnostics: one-vs-rest AUC and average precision, lift, quantiles, threshold search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import threshold_label
from tideline.operators.metrics import aggregate_metrics, confusion, nonzero_metrics
from tideline.operators.ranks import RANGES, bin_of, quantiles, running
from tideline.plans.spec import LABELS

CLASSES = (("p_down", -1), ("p_unchanged", 0), ("p_up", 1))


def long_scores(scored: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """A row for each class: keys, label, score, hit."""
    rows = F.array(*[F.struct(F.lit(v).alias("label"), F.col(p).alias("score"), (F.col("y_true") == v).cast("long").alias("hit")) for p, v in CLASSES])
    return scored.select(*keys, *(extra or []), F.explode(rows).alias("r")).select(*keys, *(extra or []), "r.*")


def _by_score(scored: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """A row for each class and distinct score: positives and negatives at it, and below it."""
    steps = long_scores(scored, keys).groupBy(*keys, "label", "score").agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    return running(steps, [*keys, "label"], "score", ["pos", "neg"], ranges)


def auc_and_precision(scored: DataFrame, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """roc_auc (ties count half) and average_precision by class; null where only one class occurs.

    What lies above a score is the class's total less what lies below, so one running sum serves both.
    """
    by = [*keys, "label"]
    run = _by_score(scored, keys, ranges)
    totals = F.broadcast(run.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")))  # a row for each key and class
    tp, fp = F.col("n_pos") - F.col("before_pos"), F.col("n_neg") - F.col("before_neg")
    # 2 * wins is an integer: sums are exact
    agg = run.join(totals, by).groupBy(*by, "n_pos", "n_neg").agg(F.sum(F.col("pos") * (2 * F.col("before_neg") + F.col("neg"))).alias("wins2"), F.sum(F.col("pos") * tp / (tp + fp)).alias("ap"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return agg.select(*by, "n_pos", "n_neg", (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("base_rate"), F.when(both, F.col("wins2") / 2 / F.col("n_pos") / F.col("n_neg")).alias("roc_auc"), F.when(both, F.col("ap") / F.col("n_pos")).alias("average_precision"))


def lift_table(scored: DataFrame, keys: list[str], bins: int = 10, tie: str = "event_id", ranges: int = RANGES) -> DataFrame:
    """Equal-count bins by falling score (bin 1 highest), ties by ``tie``: bounds, hit rate, lift over the base rate.

    A distinct score whose rows all fall in one bin is counted whole. The few scores that a bin's edge cuts (fewer than
    ``bins`` a class) are taken apart by ``tie``, again by running sums over ranges.
    """
    by = [*keys, "label"]
    run = _by_score(scored, keys, ranges).withColumn("n", F.col("pos") + F.col("neg"))
    totals = F.broadcast(run.groupBy(*by).agg(F.sum("n").alias("total")))
    placed = run.join(totals, by).withColumn("first", F.col("total") - F.col("before_pos") - F.col("before_neg") - F.col("n"))
    placed = placed.withColumn("bin", bin_of(F.col("first"), F.col("total"), bins)).withColumn("last_bin", bin_of(F.col("first") + F.col("n") - 1, F.col("total"), bins))
    whole = placed.where("bin = last_bin").select(*by, "bin", "score", "n", F.col("pos").alias("hits"))
    cut = placed.where("bin < last_bin").select(*by, "score", "first", "total")
    apart = long_scores(scored, keys, [tie]).join(F.broadcast(cut), [*by, "score"])
    single = apart.groupBy(*by, "score", "first", "total", tie).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    dealt = running(single, [*by, "score"], tie, ["n"], ranges)
    split = dealt.select(*by, bin_of(F.col("first") + F.col("before_n"), F.col("total"), bins).alias("bin"), "score", "n", "hits")
    per = whole.unionByName(split).groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    of_class = Window.partitionBy(*by)
    base = F.sum("hits").over(of_class) / F.sum("n").over(of_class)
    return per.withColumn("rate", F.col("hits") / F.col("n")).withColumn("base_rate", base).withColumn("lift", F.when(F.col("base_rate") > 0, F.col("rate") / F.col("base_rate")))


QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def probability_by_true_class(scored: DataFrame, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """Per true class and probability: n, mean, deviation, exact quantiles (linear interpolation)."""
    rows = F.array(*[F.struct(F.lit(v).alias("prob_label"), F.col(p).alias("p")) for p, v in CLASSES])
    by = [*keys, "true_label", "prob_label"]
    long = scored.select(*keys, F.col("y_true").alias("true_label"), F.explode(rows).alias("r")).select(*keys, "true_label", "r.*")
    moments = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean"), F.stddev_samp("p").alias("std"))
    return moments.join(F.broadcast(quantiles(long, by, "p", QUANTILES, ranges)), by, "left").select(*by, "n", "mean", "std", *[F.col(f"q{i}").alias(f"q{round(100 * x):02d}") for i, x in enumerate(QUANTILES)])


def validation_bundle(scored: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Everything that is told about validation scores: AUC and precision, probabilities by class, lift, grid, best thresholds and their confusion."""
    grid = threshold_grid(scored, keys)
    best = best_thresholds(grid, keys, "macro_f1").unionByName(best_thresholds(grid, keys, "balanced_accuracy"))
    return {
        "auc_average_precision": auc_and_precision(scored, keys), "probability_by_true_class": probability_by_true_class(scored, keys), "lift": lift_table(scored, keys),
        "threshold_grid": grid, "best_thresholds": best, "best_confusion": best_confusion(scored, best.where("selection_metric = 'macro_f1'"), keys),
    }


def default_grid() -> tuple[float, ...]:
    """0.100, 0.125, ..., 0.450."""
    return tuple(round(0.1 + 0.025 * i, 3) for i in range(15))


def check_grid(grid: tuple[float, ...]) -> tuple[float, ...]:
    if not grid or any(not 0 <= g <= 1 for g in grid) or len(set(grid)) != len(grid):
        raise ValueError("thresholds must be unique and from 0 to 1")
    return tuple(sorted(grid))


def threshold_grid(scored: DataFrame, keys: list[str], grid: tuple[float, ...] | None = None) -> DataFrame:
    """Confusion counts and metrics for all pairs of thresholds.

    A row signals down only where p_down > p_up, and up only where p_up >= p_down, so the two never meet: one pass
    counts, by true class, the signals of each threshold alone, and a pair's confusion is base plus two contributions.
    """
    g = check_grid(grid or default_grid())
    edges = F.array(*[F.lit(t) for t in g])
    is_up = F.col("p_up") >= F.col("p_down")
    # how many thresholds the row's side reaches: one number a row, then counts by it
    reached = F.size(F.filter(edges, lambda t: F.when(is_up, F.col("p_up")).otherwise(F.col("p_down")) >= t))
    by_step = scored.groupBy(*keys, "y_true", is_up.alias("is_up"), reached.alias("reached")).agg(F.count(F.lit(1)).alias("n"))  # at most 6 * (thresholds + 1) rows a key
    n = lambda *conditions: F.sum(F.when(reduce(lambda x, y: x & y, conditions), F.col("n")).otherwise(0))
    counts: list[Column] = []
    for i, v in enumerate(LABELS):
        of = F.col("y_true") == v
        counts.append(n(of).alias(f"all{i}"))
        for k in range(len(g)):
            counts.append(n(of, F.col("is_up"), F.col("reached") > k).alias(f"u{k}_{i}"))
            counts.append(n(of, ~F.col("is_up"), F.col("reached") > k).alias(f"d{k}_{i}"))
    one = by_step.groupBy(*keys).agg(*counts)
    sides = {s: F.array(*[F.struct(F.lit(t).alias("t"), *[F.col(f"{s}{k}_{i}").alias(f"c{i}") for i in range(3)]) for k, t in enumerate(g)]) for s in "du"}
    base = [F.col(f"all{i}") for i in range(3)]
    pairs = one.select(*keys, *base, F.explode(sides["d"]).alias("d"), sides["u"].alias("us")).select("*", F.explode("us").alias("u"))
    cells = [x for i in range(3) for x in (F.col(f"d.c{i}").alias(f"n{i}0"), (F.col(f"all{i}") - F.col(f"d.c{i}") - F.col(f"u.c{i}")).alias(f"n{i}1"), F.col(f"u.c{i}").alias(f"n{i}2"))]
    return nonzero_metrics(aggregate_metrics(pairs.select(*keys, F.col("d.t").alias("threshold_down"), F.col("u.t").alias("threshold_up"), *cells)))


def best_thresholds(results: DataFrame, keys: list[str], metric: str = "macro_f1") -> DataFrame:
    """The best pair: by the metric, then the other, then accuracy, then lower thresholds."""
    other = "balanced_accuracy" if metric == "macro_f1" else "macro_f1"
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc(), F.col(other).desc(), F.col("accuracy").desc(), "threshold_down", "threshold_up")
    return results.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place").withColumn("selection_metric", F.lit(metric))


def with_thresholds(scored: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions under the chosen thresholds of each key (one row a key, broadcast)."""
    chosen = F.broadcast(best.select(*keys, "threshold_down", "threshold_up"))
    return scored.join(chosen, keys).withColumn("y_pred", threshold_label(F.col("p_down"), F.col("p_up"), F.col("threshold_down"), F.col("threshold_up")))


def best_confusion(scored: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    return confusion(with_thresholds(scored, best, keys), keys)


def freeze_thresholds(best: DataFrame, identity: dict[str, str]) -> dict[int, dict]:
    """{horizon: thresholds with the identity they were chosen under}; one row a horizon."""
    return {r.horizon: {"down": r.threshold_down, "up": r.threshold_up, **identity} for r in best.collect()}


def require_thresholds(frozen: dict[int, dict], horizons: tuple[int, ...], identity: dict[str, str]) -> dict[int, tuple[float, float]]:
    """Thresholds for use; a missing horizon or another identity is refused."""
    for h in horizons:
        if h not in frozen or any(frozen[h].get(k) != v for k, v in identity.items()):
            raise ValueError(f"thresholds for horizon {h} are missing or were chosen under another identity")
    return {h: (frozen[h]["down"], frozen[h]["up"]) for h in horizons}
