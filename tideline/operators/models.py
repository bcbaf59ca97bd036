"""Multinomial logistic models: frozen coefficients scored as columns, fitting with MLlib, artifacts with hashes."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.scalar import argmax_label
from tideline.operators.validate import check_numeric
from tideline.plans.spec import LABELS
from tideline.sources.sinks import exists, file_sha256, read_text, write_text


@dataclass(frozen=True)
class FitConfig:
    """How a model is fitted: inverse penalty, iterations, tolerance, features kept in the order given."""

    c: float = 1.0
    max_iter: int = 200
    tol: float = 1e-6
    parity: float = 1e-12

    def __post_init__(self) -> None:
        if not (self.c > 0 and self.max_iter > 0 and self.tol > 0 and self.parity > 0):
            raise ValueError(f"all settings of a fit must be positive: {self}")


@dataclass(frozen=True)
class FrozenModel:
    """Scaler and coefficients of one horizon; classes are -1, 0, 1."""

    name: str
    horizon: int
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coefficients: tuple[tuple[float, ...], ...]  # a row for each class
    intercepts: tuple[float, ...]
    converged: bool = True
    spec_fingerprint: str = ""
    dataset_sha256: str = ""
    source_sha256: str = ""
    iterations: int = 0
    classes: tuple[int, ...] = LABELS

    def __post_init__(self) -> None:
        k = len(self.features)
        if not self.name.strip() or self.horizon <= 0:
            raise ValueError("a model needs a name and a positive horizon")
        if not k or len(set(self.features)) != k or len(self.mean) != k or len(self.scale) != k or any(len(r) != k for r in self.coefficients) or len(self.coefficients) != len(self.classes) or len(self.intercepts) != len(self.classes):
            raise ValueError("the model's parts do not fit together")
        if not all(math.isfinite(x) for x in (*self.mean, *self.scale, *self.intercepts, *(x for r in self.coefficients for x in r))):
            raise ValueError("parameters must be finite")
        if any(s <= 0 for s in self.scale):
            raise ValueError("scales must be positive")

    def logits(self) -> list[Column]:
        scaled = [(F.col(f).cast("double") - F.lit(m)) / F.lit(s) for f, m, s in zip(self.features, self.mean, self.scale, strict=True)]
        return [reduce(lambda x, y: x + y, [F.lit(w) * x for w, x in zip(row, scaled, strict=True)], F.lit(b)) for row, b in zip(self.coefficients, self.intercepts, strict=True)]

    def sha256(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps({"model": asdict(self), "sha256": self.sha256()}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> FrozenModel:
        """Load; content that does not match its hash is refused."""
        doc = json.loads(text)
        m = doc["model"]
        tup = lambda v: tuple(tup(x) for x in v) if isinstance(v, list) else v
        model = cls(**{k: tup(v) for k, v in m.items()})
        if model.sha256() != doc["sha256"]:
            raise ValueError("the model's content does not match its hash")
        return model

    def require(self, *, name: str, horizon: int, features: tuple[str, ...], spec_fingerprint: str = "", dataset_sha256: str | None = None, source_sha256: str | None = None) -> None:
        """The guard before scoring: same name, horizon, features in order, classes in order, fingerprints, and converged."""
        wanted = {"name": name, "horizon": horizon, "features": tuple(features), "classes": LABELS, "spec_fingerprint": spec_fingerprint, "dataset_sha256": dataset_sha256, "source_sha256": source_sha256}
        wrong = [k for k, v in wanted.items() if v is not None and getattr(self, k) != v]
        if wrong or not self.converged:
            raise ValueError(f"the model does not fit: {wrong or 'not converged'}")


def save_model(spark: SparkSession, model: FrozenModel, base: str, overwrite: bool = False) -> tuple[str, str]:
    """``base.arrays.json`` with the numbers and ``base.json`` with the rest and the hash of the numbers, which is written last."""
    arrays, rest = f"{base}.arrays.json", f"{base}.json"
    if not overwrite and (exists(spark, arrays) or exists(spark, rest)):
        raise FileExistsError(base)
    doc = asdict(model)
    numbers = {k: doc.pop(k) for k in ("classes", "coefficients", "intercepts", "mean", "scale")}
    write_text(spark, json.dumps(numbers, sort_keys=True), arrays)
    write_text(spark, json.dumps({"model": doc, "arrays_sha256": file_sha256(spark, arrays), "sha256": model.sha256()}, indent=2, sort_keys=True), rest)
    return arrays, rest


def load_model(spark: SparkSession, base: str) -> FrozenModel:
    """Numbers that do not have the hash that was noted, and models whose content does not have theirs, are refused."""
    for path in (arrays := f"{base}.arrays.json", rest := f"{base}.json"):
        if not exists(spark, path):
            raise FileNotFoundError(path)
    doc = json.loads(read_text(spark, rest))
    if file_sha256(spark, arrays) != doc.get("arrays_sha256"):
        raise ValueError(f"{arrays} does not have the noted hash")
    return FrozenModel.from_json(json.dumps({"model": {**doc["model"], **json.loads(read_text(spark, arrays))}, "sha256": doc["sha256"]}))


def load_models(spark: SparkSession, bases: dict[int, str], **required) -> dict[int, FrozenModel]:
    """horizon -> its model, each of which must meet the guard."""
    out = {h: load_model(spark, base) for h, base in bases.items()}
    for h, m in out.items():
        m.require(horizon=h, **required)
    return out


def logits_by_horizon(data: DataFrame, models: dict[int, FrozenModel], keep: list[str]) -> DataFrame:
    """A row for each horizon: ``keep``, horizon, y_true and the logits z0, z1, z2 of its model.

    Each row brings its model's numbers, so the rule of a logit stands in the generated code once, not once a horizon: the
    code of many models would be too large for the JIT compiler. Numbers and their order are those of ``logits``.
    """
    names = next(iter(models.values())).features
    if any(m.features != names for m in models.values()):
        raise ValueError("the models of all horizons need the same features")
    numbers = lambda m: {**{f"m{i}": x for i, x in enumerate(m.mean)}, **{f"s{i}": x for i, x in enumerate(m.scale)}, **{f"b{k}": x for k, x in enumerate(m.intercepts)}, **{f"w{k}_{i}": x for k, row in enumerate(m.coefficients) for i, x in enumerate(row)}}
    long = data.withColumn("__m", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.lit(x).alias(n) for n, x in numbers(m).items()]) for h, m in models.items()])))
    m = F.col("__m")
    y_true = F.coalesce(*[F.when(m["horizon"] == h, F.col(f"y_{h}")) for h in models])
    scaled = long.select(*keep, m["horizon"].alias("horizon"), y_true.alias("y_true"), "__m", *[((F.col(f).cast("double") - m[f"m{i}"]) / m[f"s{i}"]).alias(f"__x{i}") for i, f in enumerate(names)])
    z = [reduce(lambda x, y: x + y, [m[f"w{k}_{i}"] * F.col(f"__x{i}") for i in range(len(names))], m[f"b{k}"]).alias(f"z{k}") for k in range(len(LABELS))]
    return scaled.select(*keep, "horizon", "y_true", *z)


def softmax_columns(data: DataFrame, logits: list[str], names: list[str], decimals: int | None = None) -> DataFrame:
    """Replace columns of logits by probabilities, in named steps that keep generated code small."""
    top = data.withColumn("__top", F.greatest(*logits))
    powers = top.withColumns({z: F.exp(F.col(z) - F.col("__top")) for z in logits})
    total = powers.withColumn("__top", reduce(lambda x, y: x + y, [F.col(z) for z in logits]))
    p = [F.col(z) / F.col("__top") for z in logits]
    return total.withColumns(dict(zip(names, [F.round(x, decimals) for x in p] if decimals is not None else p, strict=True))).drop("__top", *logits)


def score(data: DataFrame, model: FrozenModel, decimals: int | None = None) -> DataFrame:
    """Add p_down, p_unchanged, p_up and argmax; plain columns, no Python on executors."""
    z = data.withColumns(dict(zip(("__z0", "__z1", "__z2"), model.logits(), strict=True)))
    named = softmax_columns(z, ["__z0", "__z1", "__z2"], ["p_down", "p_unchanged", "p_up"], decimals)
    return named.withColumn("argmax", argmax_label([F.col("p_down"), F.col("p_unchanged"), F.col("p_up")], LABELS))


def scaler_stats(train: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """feature, mean, population deviation (1 where it is 0), one pass."""
    one = train.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in features for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.when(F.col(f"{c}__sd") > 0, F.col(f"{c}__sd")).otherwise(1.0).alias("scale")) for c in features])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def standardised(data: DataFrame, features: tuple[str, ...], stats: dict[str, tuple[float, float]], keep: list[str] | None = None) -> DataFrame:
    """Features less their mean, over their scale, in double; ``keep`` columns stay."""
    return data.select(*(keep or []), *[((F.col(f).cast("double") - F.lit(stats[f][0])) / F.lit(stats[f][1])).alias(f) for f in features])


def fit(train: DataFrame, features: tuple[str, ...], horizon: int, name: str = "full_logistic", config: FitConfig | None = None, spec_fingerprint: str = "", dataset_sha256: str = "", source_sha256: str = "") -> FrozenModel:
    """L2 multinomial logistic regression on features scaled by training statistics; needs all three classes and finite features.

    The penalty is 1 / (c * rows) and intercepts are free. The fit fails if it stops at ``max_iter``, or if the frozen
    model's probabilities differ from the fitted one's by more than ``parity`` on any training row.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    config, label = config or FitConfig(), f"y_{horizon}"
    check_numeric(train, tuple(features), "training rows")
    stats = {r.feature: (float(r["mean"]), float(r["scale"])) for r in scaler_stats(train, features).collect()}
    seen = {r[0] for r in train.select(label).distinct().collect()}
    if seen != set(LABELS):
        raise ValueError(f"training rows hold the classes {sorted(seen, key=str)}, not all three")
    scaled = standardised(train.withColumn("label", (F.col(label) + 1).cast("double")), features, stats, ["label"])
    rows = VectorAssembler(inputCols=list(features), outputCol="vector").transform(scaled).select("label", "vector").persist()
    try:
        n = rows.count()
        fitted = LogisticRegression(featuresCol="vector", family="multinomial", regParam=1 / (config.c * n), elasticNetParam=0.0, standardization=False, maxIter=config.max_iter, tol=config.tol).fit(rows)
        if fitted.summary.totalIterations >= config.max_iter:
            raise RuntimeError(f"no convergence in {config.max_iter} iterations")
        w = fitted.coefficientMatrix.toArray()
        model = FrozenModel(name, horizon, tuple(features), tuple(stats[f][0] for f in features), tuple(stats[f][1] for f in features), tuple(tuple(map(float, r)) for r in w), tuple(map(float, fitted.interceptVector.toArray())), True, spec_fingerprint, dataset_sha256, source_sha256, int(fitted.summary.totalIterations))
        # the frozen model on scaled features, so that both see the same numbers
        plain = FrozenModel(name, horizon, tuple(features), (0.0,) * len(features), (1.0,) * len(features), model.coefficients, model.intercepts)
        both = score(fitted.transform(rows).select(vector_to_array("probability").alias("p"), vector_to_array("vector").alias("v")).select("p", *[F.col("v")[i].alias(f) for i, f in enumerate(features)]), plain)
        worst = both.agg(F.max(F.greatest(*[F.abs(F.col("p")[i] - F.col(c)) for i, c in enumerate(("p_down", "p_unchanged", "p_up"))]))).first()[0]
        if worst > config.parity:
            raise ValueError(f"frozen and fitted probabilities differ by {worst:.3e}")
    finally:
        rows.unpersist()
    return model


def coefficient_table(spark: SparkSession, models: list[FrozenModel]) -> DataFrame:
    rows = [(m.name, m.horizon, f, label, float(w)) for m in models for label, r in zip(LABELS, m.coefficients, strict=True) for f, w in zip(m.features, r, strict=True)]
    return spark.createDataFrame(rows, "model string, horizon int, feature string, label int, coefficient double")


def coefficient_interpretation(coefficients: DataFrame) -> DataFrame:
    """Per model, horizon and feature: the coefficients of the classes, up minus down, whether their signs differ, and moves against no move."""
    wide = coefficients.groupBy("model", "horizon", "feature").pivot("label", list(LABELS)).agg(F.first("coefficient"))
    down, flat, up = F.col("-1"), F.col("0"), F.col("1")
    return wide.select(
        "model", "horizon", "feature", down.alias("coef_down"), flat.alias("coef_unchanged"), up.alias("coef_up"), (up - down).alias("up_minus_down"),
        (F.signum(down) != F.signum(up)).alias("opposite_sign_down_up"), ((F.abs(down) + F.abs(up)) / (F.abs(flat) + 1e-12)).alias("move_vs_unchanged"),
    )


def sign_stability(coefficients: DataFrame) -> DataFrame:
    """Per model and feature: signs of each class over the horizons in order, whether up and down differ in all, mean size of up minus down."""
    rows = coefficient_interpretation(coefficients)
    names = {"down": "coef_down", "unchanged": "coef_unchanged", "up": "coef_up"}
    signs = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("horizon", F.signum(c).cast("int").alias("s")))), lambda x: x["s"].cast("string")), ",")
    return rows.groupBy("model", "feature").agg(F.count(F.lit(1)).alias("n_horizons"), *[signs(c).alias(f"{n}_signs") for n, c in names.items()], F.bool_and("opposite_sign_down_up").alias("opposite_in_all"), F.avg(F.abs("up_minus_down")).alias("mean_abs_up_minus_down"))


def top_asymmetry(stability: DataFrame) -> DataFrame:
    """The feature of each model with the greatest mean difference between up and down; the first by name on ties."""
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.col("mean_abs_up_minus_down").desc(), "feature"))
    return stability.withColumn("place", place).where("place = 1").select("model", "feature", "mean_abs_up_minus_down")
