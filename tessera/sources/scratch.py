"""Folders for what queries keep, where driver and executors both see it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple, str] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session without it (as in tests) gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared folder")
    key = (spark.sparkContext.applicationId, "root")
    if key not in _made:
        _made[key] = tempfile.mkdtemp(prefix="tessera-")
    return _made[key]


def once(spark: SparkSession, kind: str, table: str, make) -> str:
    """The folder that ``make(folder)`` filled from ``table``; kept for the session as long as the table's files stay the same."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = fs.getFileStatus(path)
    files = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path))
    key = (spark.sparkContext.applicationId, kind, table, state.getModificationTime(), *files)
    if key not in _made:
        folder = f"{root(spark)}/{kind}-{uuid.uuid4().hex}"
        make(folder)
        _made[key] = folder
    return _made[key]


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a checkpoint in the shared folder: its readers don't compute it again, and a lost executor costs no lineage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root(spark))
    return df.checkpoint()


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` written in columns to the shared folder for as long as it is in use; results that outlive it are to be saved."""
    spark = df.sparkSession
    folder = f"{root(spark)}/kept-{uuid.uuid4().hex}"
    try:
        df.write.parquet(folder)
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
