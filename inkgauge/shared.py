"""Written tables in the folder that driver and executors share, and their end."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='inkgauge-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_scopes: list[list[str]] = []


def written(df: DataFrame, scope: int = -1) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later stages depend on files, not on lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    if len(_scopes) >= -scope:
        _scopes[scope].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lasting(df: DataFrame) -> DataFrame:
    """As written, but the table outlives the scope it is made in."""
    return written(df, -2)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; what is needed longer is lasting."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
