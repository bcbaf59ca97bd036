"""Writing results: staged folders that are swapped in whole, splits with a manifest, checkpoints, run records.

All paths go through Spark's file systems, so that a shared store works as a local folder does. Small texts (JSON) are
written by the driver; tables are written by executors.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import math
import resource
import subprocess
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalar import json_ready
from tideline.operators.splits import dataset_manifest
from tideline.plans.spec import SPLITS, Spec


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def size_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return int(fs.getContentSummary(p).getLength())


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    fs, p = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def swap_in(spark: SparkSession, staged: str, target: str) -> None:
    """Put ``staged`` in the place of ``target``: the old one is set aside, and put back if the rename fails."""
    fs, new = _at(spark, staged)
    _, old = _at(spark, target)
    _, aside = _at(spark, f"{target}.old-{uuid.uuid4().hex}")
    had = fs.exists(old)
    fs.mkdirs(old.getParent())
    if had and not fs.rename(old, aside):
        raise OSError(f"cannot set {target} aside")
    try:
        done = bool(fs.rename(new, old))
    except Exception as e:  # some stores raise where others return false
        done, cause = False, e
    else:
        cause = None
    if not done:
        if had:
            fs.rename(aside, old)
        raise OSError(f"cannot put {staged} in the place of {target}") from cause
    if had:
        fs.delete(aside, True)


def write_text(spark: SparkSession, text: str, target: str) -> None:
    """A small text, written beside its place and renamed."""
    part = f"{target}.part-{uuid.uuid4().hex}"
    fs, p = _at(spark, part)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    swap_in(spark, part, target)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, value, target: str) -> None:
    write_text(spark, json.dumps(json_ready(value), indent=2, sort_keys=True), target)


def write_csv(table: DataFrame, target: str, order: list[str] | None = None, overwrite: bool = True) -> None:
    """A result table of few rows as one CSV file with a header, written beside its place and renamed; null and NaN are empty."""
    spark = table.sparkSession
    if not overwrite and exists(spark, target):
        raise FileExistsError(target)
    out = io.StringIO()
    rows = csv.writer(out, lineterminator="\n")
    rows.writerow(table.columns)
    for r in (table.orderBy(*order) if order else table).collect():
        rows.writerow(["" if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r])
    write_text(spark, out.getvalue(), target)


def write_reports(tables: dict[str, DataFrame], folder: str, prefix: str, overwrite: bool = True) -> list[str]:
    """Result tables as ``folder/<prefix>_<name>.csv``; returns the paths."""
    paths = []
    for name, t in tables.items():
        keys = [c for c in t.columns if c in ("model", "horizon", "split", "utc_day", "regime", "side", "label", "true_label", "pred_label", "bin", "feature")]
        write_csv(t, path := f"{folder}/{prefix}_{name}.csv", keys or None, overwrite)
        paths.append(path)
    return paths


def write_table(df: DataFrame, target: str, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet (zstd) in a folder beside ``target``, swapped in when it is whole; leaves nothing behind on failure."""
    spark = df.sparkSession
    if not overwrite and exists(spark, target):
        raise FileExistsError(target)
    staged = f"{target}.staged-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(staged)
        swap_in(spark, staged, target)
    finally:
        fs, p = _at(spark, staged)
        fs.delete(p, True)


def write_splits(data: DataFrame, target: str, spec: Spec, overwrite: bool = False, window: tuple[int, int] | None = None) -> dict:
    """The model table by split, with ``_manifest.json``; every split must have rows. Returns the manifest.

    The manifest holds rows, ids and times of each split as they were written, and with ``window`` the rules and the
    boundaries in time too.
    """
    spark = data.sparkSession
    if not overwrite and exists(spark, target):
        raise FileExistsError(target)
    staged = f"{target}.staged-{uuid.uuid4().hex}"
    try:
        data.where(F.col("split").isin(*SPLITS)).write.option("compression", "zstd").partitionBy("split").parquet(staged)
        written = spark.read.parquet(staged)
        rows = {r["split"]: r for r in written.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_event_id"), F.max("event_id").alias("last_event_id"), F.min("us").alias("start_us"), F.max("us").alias("end_us")).collect()}
        if missing := [s for s in SPLITS if s not in rows]:
            raise ValueError(f"no rows in {', '.join(missing)}")
        manifest = {"spec_fingerprint": spec.fingerprint(), "splits": {s: {k: v for k, v in rows[s].asDict().items() if k != "split"} for s in SPLITS}}
        if window is not None:
            manifest["dataset"] = dataset_manifest(written, spec, *window)
        write_json(spark, manifest, f"{staged}/_manifest.json")
        swap_in(spark, staged, target)
    finally:
        fs, p = _at(spark, staged)
        fs.delete(p, True)
    return manifest


def write_compact(rows: DataFrame, target: str, expected: int, overwrite: bool = False) -> int:
    """Compact predictions as a table; their number must be the expected one before it is put in place, and after."""
    spark = rows.sparkSession
    if not overwrite and exists(spark, target):
        raise FileExistsError(target)
    staged = f"{target}.staged-{uuid.uuid4().hex}"
    try:
        rows.write.option("compression", "zstd").parquet(staged)
        if (n := spark.read.parquet(staged).count()) != expected:
            raise ValueError(f"{n} rows were written, {expected} expected")
        swap_in(spark, staged, target)
        if (n := spark.read.parquet(target).count()) != expected:
            raise ValueError(f"{target} holds {n} rows, {expected} expected")
    finally:
        fs, p = _at(spark, staged)
        fs.delete(p, True)
    return expected


def load_splits(spark: SparkSession, path: str, splits: tuple[str, ...] = SPLITS, columns: tuple[str, ...] = (), eligible_only: bool = False, spec: Spec | None = None) -> dict[str, DataFrame]:
    """split -> its rows, pruned to ``columns``; split and eligibility reach the scan as filters."""
    if not splits or len(set(splits)) != len(splits) or not set(splits) <= set(SPLITS):
        raise ValueError(f"splits must be given, unique and among {SPLITS}")
    if spec is not None and json.loads(read_text(spark, f"{path}/_manifest.json"))["spec_fingerprint"] != spec.fingerprint():
        raise ValueError("the splits were made for another spec")
    data = spark.read.parquet(path)
    if lacking := [c for c in columns if c not in data.columns]:
        raise ValueError(f"no columns {lacking}")
    if eligible_only:
        data = data.where("model_eligible")
    return {s: data.where(F.col("split") == s).select(*(columns or data.columns)) for s in splits}


class HorizonStore:
    """Finished parts of an experiment, each with its identity and the hashes of its tables; a part that differs is refused."""

    def __init__(self, spark: SparkSession, folder: str, identity: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.identity = hashlib.sha256(json.dumps(json_ready(identity), sort_keys=True).encode()).hexdigest()

    def _note(self, horizon: int) -> str:
        return f"{self.folder}/h{horizon}.json"

    def exists(self, horizon: int) -> bool:
        return exists(self.spark, self._note(horizon))

    def save(self, horizon: int, tables: dict[str, DataFrame], parameters: str = "", overwrite: bool = False) -> None:
        """The note that makes a part count is written last. ``parameters`` is the fingerprint of the model the tables are of."""
        if self.exists(horizon) and not overwrite:
            raise FileExistsError(f"horizon {horizon} is stored already")
        hashes = {}
        for name, df in tables.items():
            write_table(df, f"{self.folder}/h{horizon}/{name}", overwrite=True)
            hashes[name] = table_sha256(self.spark.read.parquet(f"{self.folder}/h{horizon}/{name}"))
        write_json(self.spark, {"identity": self.identity, "parameters": parameters, "tables": hashes}, self._note(horizon))

    def load(self, horizon: int, parameters: str = "") -> dict[str, DataFrame] | None:
        """None if the part is not finished."""
        if not self.exists(horizon):
            return None
        doc = json.loads(read_text(self.spark, self._note(horizon)))
        if doc["identity"] != self.identity:
            raise ValueError(f"horizon {horizon} was stored for another experiment")
        if doc["parameters"] != parameters:
            raise ValueError(f"horizon {horizon} was stored for a model with other parameters")
        out = {name: self.spark.read.parquet(f"{self.folder}/h{horizon}/{name}") for name in doc["tables"]}
        if wrong := [n for n, df in out.items() if table_sha256(df) != doc["tables"][n]]:
            raise ValueError(f"stored tables changed: {wrong}")
        return out


def table_sha256(rows: DataFrame) -> str:
    """A hash of a table's columns and rows whatever their order: from sums over the parts of each row's own hash.

    Sums over rows are made by executors; only a few numbers come to the driver.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda a: F.sum(F.conv(F.substring(digest, a, 15), 16, 10).cast("decimal(38,0)"))
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[part(a).alias(f"s{a}") for a in (1, 16, 31, 46)]).first()
    return hashlib.sha256(f"{sorted(rows.dtypes)}|{tuple(r)}".encode()).hexdigest()


def file_sha256(spark: SparkSession, path: str) -> str:
    """Of a file's bytes, read in pieces."""
    fs, p = _at(spark, path)
    stream, digest = fs.open(p), hashlib.sha256()
    try:
        while piece := bytes(stream.readNBytes(1 << 20)):
            digest.update(piece)
    finally:
        stream.close()
    return digest.hexdigest()


def source_sha256(folder: str, pattern: str = "*.py") -> str:
    """Of the names and contents of a source tree's files, in order."""
    digest = hashlib.sha256()
    for f in sorted(Path(folder).rglob(pattern)):
        digest.update(f.relative_to(folder).as_posix().encode() + b"\0" + f.read_bytes())
    return digest.hexdigest()


def result_manifest(spark: SparkSession, paths: list[str], audit_status: str | None = None) -> DataFrame:
    """path, found, mb of result files and folders, in the order given; the audit's status if there is one."""
    rows = [(i, p, found := exists(spark, p), round(size_bytes(spark, p) / 1e6, 3) if found else None, audit_status) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "position int, path string, found boolean, mb double, audit_status string")


def write_manifest(manifest: DataFrame, target: str) -> None:
    """The manifest as ``target.csv`` and, to be read, ``target.md``."""
    write_csv(manifest, f"{target}.csv", ["position"])
    lines = ["| path | found | MB |", "| --- | --- | --- |", *[f"| {r.path} | {'yes' if r.found else 'no'} | {'' if r.mb is None else r.mb} |" for r in manifest.orderBy("position").collect()]]
    write_text(manifest.sparkSession, "\n".join(lines) + "\n", f"{target}.md")


def git_state(folder: str) -> dict:
    """Commit and cleanness of a work tree; nulls where there is none."""

    def ask(*words: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, timeout=30, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    changes = ask("status", "--porcelain")
    return {"commit": ask("rev-parse", "HEAD"), "clean": None if changes is None else not changes}


@contextmanager
def recorded_run(spark: SparkSession, name: str, folder: str, parameters: dict | None = None, source: str | None = None, require_clean: bool = False) -> Iterator[dict]:
    """Writes ``folder/name.json`` and a copy by run id, for success and failure; yields a dict for facts of the run.

    With ``source`` (a folder), its commit and hash are part of the record; a work tree that is not clean may be refused.
    """
    state = {} if source is None else {**git_state(source), "sha256": source_sha256(source)}
    if require_clean and state.get("clean") is not True:
        raise RuntimeError("the work tree is not clean")
    record = {"name": name, "run_id": uuid.uuid4().hex, "application": spark.sparkContext.applicationId, "spark": spark.version, "parameters": parameters or {}, "source": state, "facts": {}}
    start = time.time()
    try:
        yield record["facts"]
        record["status"] = "success"
    except BaseException as e:
        record |= {"status": "failure", "error": f"{type(e).__name__}: {e}"}
        raise
    finally:
        record["elapsed_s"] = round(time.time() - start, 3)
        record["peak_rss_mb"] = round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)
        for target in (f"{folder}/{name}.json", f"{folder}/history/{name}-{record['run_id']}.json"):
            write_json(spark, record, target)
