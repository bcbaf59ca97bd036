"""Fits, artifacts, checkpoints, experiments and final test on a small dataset."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import experiment, models
from tideline.plans.spec import Spec
from tideline.sources import datasets, sinks

SPEC = Spec(horizons=(10, 20), features=("a", "b"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(61)
    rows = []
    for i in range(900):
        a, b = rng.gauss(2, 3), rng.gauss(-1, 0.5)
        y = [max((-1, 0, 1), key=lambda c: c * a * s / 3 - (c == 0) * 0.2 + rng.gauss(0, 1)) for s in (1, -1)]
        rows.append((i, i * 10, "train" if i < 500 else "validation" if i < 700 else "test", i % 50 != 0, a, b, *y))
    path = str(tmp_path_factory.mktemp("experiment"))
    data = spark.createDataFrame(rows, "event_id long, us long, split string, model_eligible boolean, a double, b double, y_10 int, y_20 int")
    sinks.write_splits(data, f"{path}/model_data", SPEC)
    data.write.parquet(f"{path}/other.parquet")
    return path


def test_dataset_access(spark, folder, tmp_path):
    at = datasets.resolve(spark, folder, "model_data")
    assert at.layout == "partitioned" and datasets.resolve(spark, folder, "other").layout == "single"
    with pytest.raises(FileNotFoundError):
        datasets.resolve(spark, folder, "none")
    sinks.write_table(spark.range(1), f"{tmp_path}/part/split=train")
    with pytest.raises(FileNotFoundError, match="validation"):
        datasets.resolve(spark, str(tmp_path), "part")
    for place in (at, datasets.resolve(spark, folder, "other")):
        assert datasets.split_rows(spark, place, "train") == 490 and datasets.split_rows(spark, place, "test", eligible_only=False) == 200
        rows = datasets.load_split(spark, place, "validation", ("event_id", "a"))
        assert rows.columns == ["event_id", "a"]
        parts = list(datasets.ordered_batches(rows, size=80))
        assert [p.num_rows for p in parts] == [80, 80, 36] and sum((p["event_id"].to_pylist() for p in parts), []) == sorted(r.event_id for r in rows.collect())
    with pytest.raises(ValueError):
        datasets.load_split(spark, at, "other")
    with pytest.raises(ValueError, match="missing"):
        datasets.load_split(spark, at, "train", ("zzz",))
    with pytest.raises(ValueError, match="no rows"):
        datasets.check_split(spark.read.parquet(f"{folder}/other.parquet").where("1 = 0"), "train")
    whole = spark.read.parquet(f"{folder}/other.parquet")
    assert datasets.id_range(whole, 10, 19).count() == 10 and [r.event_id for r in datasets.preview(whole, ["event_id"], 2).collect()] == [0, 1]
    with pytest.raises(ValueError, match="not whole"):
        datasets.id_range(whole, 890, 905)
    assert sorted(r.event_id for r in datasets.by_ids(whole, spark.createDataFrame([(3,), (3,), (8,), (9999,)], "event_id long")).collect()) == [3, 8]
    name = datasets.table_files(spark, f"{folder}/other.parquet")[0]
    first = [r.event_id for r in datasets.file_rows(spark, f"{folder}/other.parquet", name, 0, 7, ("event_id",)).collect()]
    assert len(first) == 7 and [r.event_id for r in datasets.file_rows(spark, f"{folder}/other.parquet", name, 3, 2).collect()] == first[3:5]
    assert all(n.endswith(".parquet") for n in datasets.table_files(spark, f"{folder}/other.parquet")) and datasets.table_rows(spark, f"{folder}/other.parquet") == 900


def test_fit_is_the_optimum(spark, folder):
    """The gradient of the penalised likelihood vanishes at the fitted parameters."""
    rows = datasets.load_split(spark, datasets.resolve(spark, folder, "model_data"), "train", ("a", "b", "y_10"))
    m = models.fit(rows, ("a", "b"), 10, config=models.FitConfig(c=0.5, tol=1e-9))
    x = rows.toPandas()
    z = np.column_stack([(x[f] - x[f].mean()) / x[f].std(ddof=0) for f in ("a", "b")])
    assert np.allclose(m.mean, [x.a.mean(), x.b.mean()]) and np.allclose(m.scale, [x.a.std(ddof=0), x.b.std(ddof=0)])
    w = np.array(m.coefficients)
    p = np.exp(z @ w.T + m.intercepts)
    p /= p.sum(1, keepdims=True)
    miss = p - np.column_stack([(x.y_10 == c) for c in (-1, 0, 1)])
    assert np.abs(miss.T @ z / len(z) + w / (0.5 * len(z))).max() < 1e-4 and np.abs(miss.mean(0)).max() < 1e-4
    with pytest.raises(RuntimeError, match="convergence"):
        models.fit(rows, ("a", "b"), 10, config=models.FitConfig(max_iter=1))
    with pytest.raises(ValueError, match="classes"):
        models.fit(rows.where("y_10 != 0"), ("a", "b"), 10)
    with pytest.raises(ValueError, match="bad_a"):
        models.fit(rows.withColumn("a", F.when(F.col("a") > 3, math.inf).otherwise(F.col("a"))), ("a", "b"), 10)
    with pytest.raises(ValueError):
        models.FitConfig(c=0)


def test_artifacts(spark, tmp_path):
    m = models.FrozenModel("m", 10, ("a", "b"), (1.0, 2.0), (2.0, 0.1), ((1.0, 1e-17), (0.1, 0.3), (-1.0, 1 / 3)), (0.0, 0.1, 0.2), dataset_sha256="d")
    arrays, rest = models.save_model(spark, m, f"{tmp_path}/m")
    assert models.load_model(spark, f"{tmp_path}/m") == m
    with pytest.raises(FileExistsError):
        models.save_model(spark, m, f"{tmp_path}/m")
    with pytest.raises(ValueError, match="does not fit"):
        models.load_models(spark, {10: f"{tmp_path}/m"}, name="m", features=("b", "a"))
    text = sinks.read_text(spark, arrays)
    sinks.write_text(spark, text.replace("0.3", "0.4"), arrays)
    with pytest.raises(ValueError, match="hash"):
        models.load_model(spark, f"{tmp_path}/m")
    sinks.write_text(spark, text, arrays)
    doc = json.loads(sinks.read_text(spark, rest))
    doc["model"]["horizon"] = 20
    sinks.write_json(spark, doc, rest)
    with pytest.raises(ValueError, match="content"):
        models.load_model(spark, f"{tmp_path}/m")
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, f"{tmp_path}/none")


def test_experiment_stops_and_goes_on(spark, folder, tmp_path, monkeypatch):
    at, out = datasets.resolve(spark, folder, "model_data"), str(tmp_path)
    plain, calls = models.fit, []

    def fit(train, features, h, *rest, **options):
        calls.append(h)
        if h == 20 and len(calls) == 2:
            raise KeyError("stopped")
        return plain(train, features, h, *rest, **options)

    monkeypatch.setattr(models, "fit", fit)
    with pytest.raises(KeyError):
        experiment.run(spark, at, SPEC, ("a", "b"), "full", out)
    assert {r.horizon for r in spark.read.csv(f"{out}/results/full_aggregate.csv", header=True, inferSchema=True).collect()} == {10}
    with pytest.raises(FileExistsError):
        experiment.run(spark, at, SPEC, ("a", "b"), "full", out)
    tables, fitted = experiment.run(spark, at, SPEC, ("a", "b"), "full", out, resume=True)
    assert calls == [10, 20, 20] and sorted(fitted) == [10, 20]
    again, _ = experiment.run(spark, at, SPEC, ("a", "b"), "full", f"{out}/again")
    for name, t in tables.items():
        assert sinks.table_sha256(t) == sinks.table_sha256(again[name])
    with pytest.raises(ValueError, match="another experiment|does not fit"):
        experiment.run(spark, at, SPEC, ("a", "b"), "full", out, models.FitConfig(c=2.0), resume=True)
    for wrong in ({"resume": True, "overwrite": True}, {"horizons": (10, 10)}, {"horizons": (30,)}):
        with pytest.raises(ValueError):
            experiment.run(spark, at, SPEC, ("a", "b"), "full", out, **wrong)
    frozen = experiment.choose_thresholds(spark, at, fitted)
    final = experiment.final_test(spark, at, fitted, frozen)
    rows = {(r.model, r.horizon): r for r in final["aggregate"].collect()}
    assert set(rows) == {(m, h) for m in ("full", "full_thresholded") for h in (10, 20)} and all(r.n_obs == 196 for r in rows.values())
    assert rows["full", 10].accuracy > 0.45
    with pytest.raises(ValueError, match="thresholds"):
        experiment.final_test(spark, at, fitted, {h: {**t, "model": "other"} for h, t in frozen.items()})
    train = datasets.load_split(spark, at, "train", ("y_10", "y_20"))
    base = experiment.baseline(train, {"train": train}, (10, 20))["aggregate"].collect()
    labels = [r.y_10 for r in train.collect()]
    assert next(r.accuracy for r in base if r.horizon == 10) == pytest.approx(max(labels.count(c) for c in (-1, 0, 1)) / len(labels))
    both = datasets.read_results(spark, f"{out}/results", {"full": "full", "again": "full"}, "aggregate")
    assert both.count() == 2 * tables["aggregate"].count()
    with pytest.raises(FileNotFoundError):
        datasets.read_results(spark, out, {"x": "x"}, "aggregate")


def test_changed_checkpoints_are_refused(spark, tmp_path):
    store = sinks.HorizonStore(spark, f"{tmp_path}/store", {"a": 1})
    assert store.load(10) is None and not store.exists(10)
    store.save(10, {"m": spark.range(4)}, "p")
    assert store.load(10, "p")["m"].count() == 4
    with pytest.raises(FileExistsError):
        store.save(10, {"m": spark.range(4)}, "p")
    with pytest.raises(ValueError, match="parameters"):
        store.load(10, "q")
    with pytest.raises(ValueError, match="another experiment"):
        sinks.HorizonStore(spark, f"{tmp_path}/store", {"a": 2}).load(10, "p")
    sinks.write_table(spark.range(1, 5), f"{tmp_path}/store/h10/m", overwrite=True)
    with pytest.raises(ValueError, match="changed"):
        store.load(10, "p")
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    assert sinks.table_sha256(a) == sinks.table_sha256(a.orderBy("s").repartition(3)) != sinks.table_sha256(a.fillna("")) != sinks.table_sha256(a.union(a))
