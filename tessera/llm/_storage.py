"""Where jobs keep what must outlive a lost executor."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where neither that nor a checkpoint folder is set, and the session is local (as in
    tests), a new temporary folder is made and set. On a cluster that is an error: executors don't
    share a folder of one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared folder for intermediate tables")
        found = tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; the lineage ends there.

    Shuffle files and checkpoints that nothing refers to any more go first. Spark removes them when the driver
    collects garbage, which many small jobs seldom make it do; Python's references (cyclic in Py4J) would hold them.
    """
    shared_dir(df.sparkSession)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df.checkpoint()


def removed(spark: SparkSession, folder: str) -> None:
    """Delete an intermediate folder, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
