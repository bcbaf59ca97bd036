"""Stage tables: a stage's result is written as Parquet once and read by the stages after it.

They lie in the folder that all executors share (spark.checkpoint.dir; a temporary one in local mode only), are kept for
the session by name and input files (names, sizes, times: a rewritten input is another one), and go when the JVM ends.
``forget`` drops what is remembered.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fingerprint(spark: SparkSession, folder: str) -> str:
    """The files under an input folder with their sizes and times of change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts, files = [], fs.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        parts.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(parts)).encode()).hexdigest()


def staged(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage ``name`` over ``source``; made and written at the first call of this application."""
    key = (spark.sparkContext.applicationId, name, f"{source}@{fingerprint(spark, source)}")
    if key not in _kept:
        path = f"{shared_folder(spark)}/{key[0]}/stage-{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])


def forget() -> None:
    _kept.clear()
