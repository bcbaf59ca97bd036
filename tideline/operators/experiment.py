"""A whole experiment on a stored dataset: a fit for each horizon, its artifact, its tables, checkpoints and published results."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import metrics, models
from tideline.operators.models import FitConfig, FrozenModel
from tideline.operators.probability import best_confusion, best_thresholds, freeze_thresholds, require_thresholds, threshold_grid
from tideline.plans.spec import Spec
from tideline.sources import datasets, sinks

KEYS = ["model", "horizon", "split"]


def evaluate(data: DataFrame, model: FrozenModel, split: str) -> DataFrame:
    """Confusion counts of the model on the rows of a split, with model, horizon and split."""
    scored = models.score(data.withColumn("y_true", F.col(f"y_{model.horizon}")), model)
    marked = scored.select(F.lit(model.name).alias("model"), F.lit(model.horizon).alias("horizon"), F.lit(split).alias("split"), "y_true", F.col("argmax").alias("y_pred"))
    return metrics.confusion(marked, KEYS)


def baseline(train: DataFrame, data: dict[str, DataFrame], horizons: tuple[int, ...], name: str = "majority") -> dict[str, DataFrame]:
    """Tables of the model that always says the most frequent training label."""
    most = F.broadcast(metrics.majority_by_horizon(train, horizons))  # a row for each horizon
    labels = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_{h}").alias("y_true")) for h in horizons])
    parts = [d.select(F.lit(s).alias("split"), F.explode(labels).alias("r")).select("split", "r.*").join(most, "horizon").select(F.lit(name).alias("model"), "horizon", "split", "y_true", F.col("majority").alias("y_pred")) for s, d in data.items()]
    return metrics.evaluation_tables(metrics.confusion(reduce(DataFrame.unionByName, parts), KEYS), KEYS)


def _publish(collected: dict[int, dict[str, DataFrame]], folder: str, prefix: str) -> dict[str, DataFrame]:
    """All horizons' tables under each other, written as CSV."""
    tables = {name: reduce(DataFrame.unionByName, [t[name] for _, t in sorted(collected.items())]) for name in next(iter(collected.values()))}
    sinks.write_reports(tables, folder, prefix)
    return tables


def run(spark: SparkSession, at: datasets.Location, spec: Spec, features: tuple[str, ...], name: str, folder: str, config: FitConfig | None = None, horizons: tuple[int, ...] | None = None, source_sha256: str = "", resume: bool = False, overwrite: bool = False) -> tuple[dict[str, DataFrame], dict[int, FrozenModel]]:
    """Fit, freeze, evaluate on train and validation, checkpoint and publish, horizon by horizon.

    Under ``folder``: models/, checkpoints/, results/. A finished horizon is reused with ``resume`` (its model and tables must
    be those of this experiment), replaced with ``overwrite``, and else an error. What is done is published after each horizon,
    so a run that was stopped goes on where it was. The test split is not read.
    """
    config, horizons = config or FitConfig(), horizons or spec.horizons
    if resume and overwrite:
        raise ValueError("resume or overwrite, not both")
    if not horizons or len(set(horizons)) != len(horizons) or not set(horizons) <= set(spec.horizons):
        raise ValueError(f"horizons must be unique and among {spec.horizons}")
    columns = ("event_id", *(f"y_{h}" for h in horizons), *features)
    train = datasets.load_split(spark, at, "train", columns)
    validation = datasets.load_split(spark, at, "validation", columns)
    dataset = sinks.table_sha256(spark.read.parquet(at.path))
    identity = {"name": name, "features": list(features), "config": asdict(config), "spec": spec.fingerprint(), "dataset": dataset, "source": source_sha256}
    store = sinks.HorizonStore(spark, f"{folder}/checkpoints/{name}", identity)
    required = {"name": name, "features": features, "spec_fingerprint": spec.fingerprint(), "dataset_sha256": dataset, "source_sha256": source_sha256}
    collected: dict[int, dict[str, DataFrame]] = {}
    fitted: dict[int, FrozenModel] = {}
    base = {h: f"{folder}/models/{name}_h{h}" for h in horizons}
    for h in horizons:
        if store.exists(h) and not (resume or overwrite):
            raise FileExistsError(f"horizon {h} is done: resume, or overwrite it")
        if resume and store.exists(h):
            fitted[h] = models.load_models(spark, {h: base[h]}, **required)[h]
            collected[h] = store.load(h, fitted[h].sha256())
    for h in (h for h in horizons if h not in collected):
        model = models.fit(train, features, h, name, config, spec.fingerprint(), dataset, source_sha256)
        models.save_model(spark, model, base[h], overwrite=overwrite or resume)
        wide = evaluate(train, model, "train").unionByName(evaluate(validation, model, "validation"))
        tables = {**metrics.evaluation_tables(wide, KEYS), "coefficients": models.coefficient_table(spark, [model])}
        store.save(h, tables, model.sha256(), overwrite=overwrite)
        fitted[h], collected[h] = model, store.load(h, model.sha256())
        _publish(collected, f"{folder}/results", name)
    return _publish(collected, f"{folder}/results", name), fitted


def choose_thresholds(spark: SparkSession, at: datasets.Location, fitted: dict[int, FrozenModel], metric: str = "macro_f1") -> dict[int, dict]:
    """Thresholds by horizon from validation rows, with the identity of the model they were chosen for."""
    out = {}
    for h, m in fitted.items():
        rows = datasets.load_split(spark, at, "validation", ("event_id", f"y_{h}", *m.features))
        grid = threshold_grid(models.score(rows, m).withColumns({"y_true": F.col(f"y_{h}"), "horizon": F.lit(h)}), ["horizon"])
        out |= freeze_thresholds(best_thresholds(grid, ["horizon"], metric), {"model": m.sha256(), "metric": metric})
    return out


def final_test(spark: SparkSession, at: datasets.Location, fitted: dict[int, FrozenModel], frozen: dict[int, dict], metric: str = "macro_f1") -> dict[str, DataFrame]:
    """Tables of the test split under arg max and under the frozen thresholds, which must be those of these models."""
    parts = []
    for h, m in fitted.items():
        down, up = require_thresholds(frozen, (h,), {"model": m.sha256(), "metric": metric})[h]
        rows = datasets.load_split(spark, at, "test", ("event_id", f"y_{h}", *m.features))
        parts.append(evaluate(rows, m, "test"))
        chosen = spark.createDataFrame([(h, down, up)], "horizon int, threshold_down double, threshold_up double")
        scored = models.score(rows, m).withColumns({"y_true": F.col(f"y_{h}"), "horizon": F.lit(h)})
        parts.append(best_confusion(scored, chosen, ["horizon"]).withColumns({"model": F.lit(f"{m.name}_thresholded"), "split": F.lit("test")}).select(*KEYS, *metrics.CELLS))
    return metrics.evaluation_tables(reduce(DataFrame.unionByName, parts), KEYS)
