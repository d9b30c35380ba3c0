"""Intermediate tables in a folder that all executors share, so that no executor holds the only copy."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files are removed behind a write, and what goes to Python at once has a bound in bytes (rows may be long).
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: On a local disk, Hadoop's file system without checksum files: for each file that it writes, an executor starts a process
#: (chmod), which shows the executor's memory as its own at first.
_LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of the warehouse where that is unset; on a cluster, a warehouse on the driver's own
    disk is an error, as executors would each write to theirs."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), spark.conf.get("spark.master", "local")
    if not master.startswith("local") and urlsplit(warehouse).scheme in ("", "file"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_shared"


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and a lost executor costs nothing twice.

    The shuffles of that one write go with its end, not when the driver happens to collect its garbage.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with _set(df.sparkSession, _WHILE_WRITING):
        df.write.options(**_LOCAL_FILES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove materialized tables that no later step reads: all that was made from them is written itself."""
    for df in tables:
        spark = df.sparkSession
        if (path := _written.pop(df, None)) and (jvm := getattr(spark, "_jvm", None)):  # elsewhere the files stay until the folder is cleared
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
