"""Reading stored tables: where a dataset lies, its splits, ranges and points of ids, ordered batches, result tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.validate import check_split, require_columns
from tideline.plans.spec import SPLITS
from tideline.sources.sinks import exists, listing


@dataclass(frozen=True)
class Location:
    """A dataset and how it is laid out: ``partitioned`` (a folder with split=... folders) or ``single`` (one table)."""

    path: str
    layout: str

    def __post_init__(self) -> None:
        if self.layout not in ("partitioned", "single"):
            raise ValueError(f"unknown layout {self.layout!r}")


def resolve(spark: SparkSession, folder: str, name: str) -> Location:
    """The partitioned dataset ``folder/name`` with all its splits, else the table ``folder/name.parquet``."""
    there = [s for s in SPLITS if exists(spark, f"{folder}/{name}/split={s}")]
    if there:
        if len(there) < len(SPLITS):
            raise FileNotFoundError(f"{folder}/{name} lacks the splits {sorted(set(SPLITS) - set(there))}")
        return Location(f"{folder}/{name}", "partitioned")
    if exists(spark, f"{folder}/{name}.parquet"):
        return Location(f"{folder}/{name}.parquet", "single")
    raise FileNotFoundError(f"neither {folder}/{name}/split=... nor {folder}/{name}.parquet")


def load_split(spark: SparkSession, at: Location, split: str, columns: tuple[str, ...] = (), eligible_only: bool = True, check: bool = True) -> DataFrame:
    """The rows of a split, pruned to ``columns``; split and eligibility reach the scan as filters. No rows are an error."""
    if split not in SPLITS:
        raise ValueError(f"{split!r} is not one of {SPLITS}")
    if len(set(columns)) != len(columns):
        raise ValueError(f"columns must be unique: {columns}")
    data = require_columns(spark.read.parquet(at.path), ["split", "model_eligible", *columns], at.path)
    rows = data.where(F.col("split") == split)
    if eligible_only:
        rows = rows.where("model_eligible")
    if check:
        check_split(rows, split)
    return rows.select(*(columns or data.columns))


def split_rows(spark: SparkSession, at: Location, split: str, eligible_only: bool = True) -> int:
    """Number of rows of a split; none is an error."""
    n = load_split(spark, at, split, ("split",), eligible_only, check=False).count()
    if not n:
        raise ValueError(f"{at.path} has no {'eligible ' if eligible_only else ''}rows of split {split}")
    return n


def ordered_batches(rows: DataFrame, key: str = "event_id", size: int = 1_000_000) -> Iterator[pa.Table]:
    """Rows in order of ``key`` as Arrow tables of at most ``size`` rows, for exports: one partition at a time is on the driver."""
    if size <= 0:
        raise ValueError("the size of a batch must be positive")
    held: list = []
    for row in rows.orderBy(key).toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict())
        if len(held) == size:
            yield pa.Table.from_pylist(held)
            held = []
    if held:
        yield pa.Table.from_pylist(held)


def id_range(rows: DataFrame, low: int, high: int, key: str = "event_id") -> DataFrame:
    """The rows of a range of dense ids, both ends in; a range that is not whole is an error."""
    if high < low:
        raise ValueError(f"{high} is below {low}")
    part = rows.where(F.col(key).between(low, high))
    found = part.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b"), F.count_distinct(key).alias("d")).first()
    if (found.n, found.a, found.b, found.d) != (high - low + 1, low, high, high - low + 1):
        raise ValueError(f"ids {low} to {high} are not whole: {found.n} rows from {found.a} to {found.b}")
    return part


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "event_id", most: int = 1_000_000) -> DataFrame:
    """The rows of the given ids, by semi-join: broadcast for up to ``most`` ids, else by shuffle."""
    wanted = ids.select(key).distinct()
    return rows.join(F.broadcast(wanted) if wanted.count() <= most else wanted, key, "left_semi")


def preview(rows: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first rows in an order."""
    return rows.orderBy(*order).limit(n)


def table_files(spark: SparkSession, path: str) -> list[str]:
    """Names of a table's Parquet files that lie in its folder itself; side files do not count."""
    return sorted(n for n in listing(spark, path) if n.endswith(".parquet") and n[0] not in "._")


def file_rows(spark: SparkSession, path: str, name: str, first: int, count: int, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``first`` to ``first + count - 1`` of one of a table's files, like those of a row group, pruned to ``columns``; only that file is read."""
    rows = spark.read.parquet(f"{path}/{name}")
    at = F.col("_metadata.row_index")
    return rows.where((at >= first) & (at < first + count)).select(*(columns or rows.columns))


def table_rows(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


def read_results(spark: SparkSession, folder: str, prefixes: dict[str, str], name: str) -> DataFrame:
    """Result tables ``folder/<prefix>_<name>.csv`` of several models under each other, with the columns they share by name."""
    out = None
    for model, prefix in prefixes.items():
        path = f"{folder}/{prefix}_{name}.csv"
        if not exists(spark, path):
            raise FileNotFoundError(f"no table {name} of {model}: {path}")
        part = spark.read.csv(path, header=True, inferSchema=True)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no models to read")
    return out
