"""Chronological splits with an embargo, their summaries and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.validate import boundary_scan as validate_scan
from tideline.operators.validate import check_features
from tideline.plans.spec import LABELS, SPLITS, Spec


def boundaries(start_us: int, end_us: int, spec: Spec) -> tuple[int, int]:
    """Ends of train and validation: shares of the time window, half open."""
    width = end_us - start_us
    return start_us + round(width * spec.train_share), start_us + round(width * (spec.train_share + spec.validation_share))


def split_of(us: Column, start_us: int, end_us: int, spec: Spec) -> Column:
    """train, validation, test by time; null outside the window."""
    a, b = boundaries(start_us, end_us, spec)
    return F.when(us < start_us, None).when(us < a, SPLITS[0]).when(us < b, SPLITS[1]).when(us < end_us, SPLITS[2])


def window_violations(features: DataFrame, start_us: int, end_us: int, spec: Spec) -> DataFrame:
    """One row: rows outside the window, splits that are missing or shorter than the embargo."""
    marked = features.select(split_of(F.col("us"), start_us, end_us, spec).alias("split"))
    n = {s: F.sum((F.col("split") == s).cast("long")) for s in SPLITS}
    short = [F.coalesce(n[s], F.lit(0)) < spec.embargo for s in SPLITS[:2]]
    return marked.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("split").isNull().cast("long")), F.lit(0)).alias("outside"), sum((x.cast("long") for x in short[1:]), short[0].cast("long")).alias("short_splits"), *[F.coalesce(n[s], F.lit(0)).alias(f"{s}_rows") for s in SPLITS])


def assign_splits(features: DataFrame, start_us: int, end_us: int, spec: Spec, check: bool = True) -> DataFrame:
    """Add split, is_boundary_drop (last ``embargo`` rows of train and validation), model_eligible.

    Rows outside the window, and a train or validation split that is missing or shorter than the embargo, are errors. Ids
    are dense, so the last rows of a split are a comparison with its greatest id: one aggregate, three rows, no window.
    """
    if check:
        check_features(features, spec.horizons)
    marked = features.withColumn("split", split_of(F.col("us"), start_us, end_us, spec))
    found = {r.split: r for r in marked.groupBy("split").agg(F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n")).collect()}  # at most four rows
    if None in found:
        raise ValueError(f"{found[None].n} rows lie outside the window")
    for s in SPLITS[:2]:
        if s not in found or found[s].n < spec.embargo:
            raise ValueError(f"split {s} has {found[s].n if s in found else 0} rows, fewer than the embargo of {spec.embargo}")
    drop = F.lit(False)
    for s in SPLITS[:2]:
        drop = drop | ((F.col("split") == s) & (F.col("event_id") > found[s].last_id - spec.embargo))
    return marked.withColumn("is_boundary_drop", drop).withColumn("model_eligible", F.col("feature_complete") & ~F.col("is_boundary_drop"))


def split_order(split: str = "split") -> Column:
    return F.when(F.col(split) == SPLITS[0], 0).when(F.col(split) == SPLITS[1], 1).otherwise(2)


def split_summary(data: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Per split: rows, flags, first and last time, labels over all rows."""
    flags = [F.sum(F.col(c).cast("long")).alias(f"{c}_rows") for c in ("feature_complete", "is_boundary_drop", "model_eligible")]
    labels = [F.sum((F.col(f"y_{h}") == v).cast("long")).alias(f"y_{h}_{n}") for h in horizons for v, n in zip(LABELS, ("down", "unchanged", "up"), strict=True)]
    return data.groupBy("split").agg(F.count(F.lit(1)).alias("rows_total"), *flags, F.min("us").alias("start_us"), F.max("us").alias("end_us"), *labels)


def row_counts(data: DataFrame) -> DataFrame:
    """split, n_rows, n_eligible."""
    return data.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("model_eligible").cast("long")).alias("n_eligible"))


def target_diagnostics(data: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Per split and horizon, eligible rows: counts, shares, non-zero share, majority (the first of -1, 0, 1 on ties)."""
    counts = [F.sum((F.col(f"y_{h}") == v).cast("long")).alias(f"c_{h}_{i}") for h in horizons for i, v in enumerate(LABELS)]
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"c_{h}_{i}").alias(n) for i, n in enumerate(("count_down", "count_unchanged", "count_up"))]) for h in horizons])
    n = F.col("count_down") + F.col("count_unchanged") + F.col("count_up")
    top = F.greatest("count_down", "count_unchanged", "count_up")
    return (
        data.where("model_eligible").groupBy("split").agg(*counts).select("split", F.explode(rows).alias("r")).select("split", "r.*").withColumn("n_obs", n)
        .withColumn("prop_down", F.col("count_down") / n).withColumn("prop_unchanged", F.col("count_unchanged") / n).withColumn("prop_up", F.col("count_up") / n)
        .withColumn("nonzero_share", (F.col("count_down") + F.col("count_up")) / n)
        .withColumn("majority_class", F.when(F.col("count_down") == top, -1).when(F.col("count_unchanged") == top, 0).otherwise(1))
    )


def target_drift(diagnostics: DataFrame) -> DataFrame:
    """Non-zero shares of the splits side by side, and their differences."""
    wide = diagnostics.groupBy("horizon").pivot("split", list(SPLITS)).agg(F.first("nonzero_share"))
    a, b, c = (F.col(s) for s in SPLITS)
    return wide.select("horizon", a.alias("train_nonzero"), b.alias("validation_nonzero"), c.alias("test_nonzero"), (b - a).alias("validation_minus_train"), (c - a).alias("test_minus_train"), F.greatest(F.abs(b - a), F.abs(c - a), F.abs(c - b)).alias("max_abs_drift"))


def boundary_audit(data: DataFrame, spec: Spec) -> DataFrame:
    """Per split: rows dropped, whether eligibility is complete and not dropped, whether eligible rows keep the embargo."""
    whole = F.bool_and(F.col("model_eligible") == (F.col("feature_complete") & ~F.col("is_boundary_drop")))
    last_eligible = F.max(F.when(F.col("model_eligible"), F.col("event_id")))
    out = data.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("is_boundary_drop").cast("long")).alias("n_dropped"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), last_eligible.alias("last_eligible_id"), whole.alias("eligibility_ok"), F.bool_or(F.col("is_boundary_drop") & F.col("model_eligible")).alias("any_dropped_eligible"))
    return out.withColumn("embargo_ok", (F.col("split") == SPLITS[2]) | (F.col("last_eligible_id") + spec.embargo <= F.col("last_id"))).withColumn("ids_contiguous", F.col("last_id") - F.col("first_id") + 1 == F.col("n_rows"))


def ids_in_order(data: DataFrame) -> DataFrame:
    """Splits follow each other: one row with whether each starts right after the one before."""
    spans = data.groupBy("split").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    w = Window.orderBy(split_order())  # three rows
    return spans.withColumn("ok", F.coalesce(F.col("a") == F.lag("b").over(w) + 1, F.col("a") == 0)).agg(F.bool_and("ok").alias("contiguous"))


def invariants(data: DataFrame, spec: Spec) -> DataFrame:
    """One row of flags and counts that hold for every table of splits: what the audits by split say, put together."""
    whole = boundary_audit(data, spec)
    spans = validate_scan(data)
    flags = whole.agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_splits"), F.bool_and("eligibility_ok").alias("eligibility_identity"), (~F.bool_or("any_dropped_eligible")).alias("no_dropped_eligible"),
        F.bool_and("embargo_ok").alias("embargo_kept"), F.bool_and(F.when(F.col("split") == SPLITS[2], F.col("n_dropped") == 0).otherwise(F.col("n_dropped") == spec.embargo)).alias("drops_as_expected"), F.bool_and("ids_contiguous").alias("ids_contiguous"),
    )
    return flags.crossJoin(spans.agg(F.bool_and("follows").alias("splits_follow")))  # one row each


def dataset_manifest(data: DataFrame, spec: Spec, start_us: int, end_us: int) -> dict:
    """Rows, times and labels of each split with the rules that made them, for a side file; three rows come to the driver."""
    rows = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in split_summary(data, spec.horizons).collect()}
    train_end, validation_end = boundaries(start_us, end_us, spec)
    rules = {"train_share": spec.train_share, "validation_share": spec.validation_share, "embargo": spec.embargo, "eligible": "feature_complete and not is_boundary_drop"}
    bounds = {"start_us": start_us, "train_end_us": train_end, "validation_end_us": validation_end, "end_us": end_us}
    return {"spec_fingerprint": spec.fingerprint(), "rules": rules, "boundaries": bounds, "features": list(spec.features), "rows_total": sum(r["rows_total"] for r in rows.values()), "splits": {s: rows[s] for s in SPLITS if s in rows}}
