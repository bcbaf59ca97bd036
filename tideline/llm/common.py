"""Pieces shared by the text operators: shared-folder tables, shipping the package, word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six bytes; `bytes.split()` cuts at exactly the same ones.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tideline-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    Cuts lineage without localCheckpoint: lost executors lose nothing. The files go with ``discard`` or when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tideline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read any more."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._tideline_path)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: nothing to do when it is on their PYTHONPATH, else send a zip."""
    top = Path(__file__).resolve().parents[2]
    if str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_tideline_sent", False):
        return
    package = Path(tempfile.mkdtemp(prefix="tideline-")) / "tideline_src.zip"
    with zipfile.ZipFile(package, "w") as z:
        for p in sorted((top / "tideline").rglob("*.py")):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(str(package))
    spark.sparkContext._tideline_sent = True


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch for this session: a batch of very long texts must fit a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def id_type(docs: DataFrame) -> str:
    """The type of the column doc_id, for the schema of a Python step that carries it."""
    return docs.schema["doc_id"].dataType.simpleString()


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def as_bytes(column) -> list:
    """An Arrow string array as a list of bytes or None, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
