"""Line logs: one JSON object a line; blank and broken lines are passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators.small import small


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def parse(lines: DataFrame, schema: str, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The objects of ``lines`` as rows of ``schema``."""
    made = F.from_json(line, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.where(F.col(line).rlike(r"\S")).select(*keep, made.alias("r"))
    return rows.where("r IS NOT NULL AND r._broken IS NULL").select(*keep, "r.*").drop("_broken")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, written, line) of all lines of the text files at ``path``; line is the number in its file, from 1.

    A file may be read in several blocks: the lines of each are counted first, and each block counts on from what those
    before it have.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_modification_time"].alias("written"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return rows.withColumn("own", within).join(small(counts), ["file", "block"]).select("value", "file", "written", (F.col("offset") + F.col("own")).alias("line"))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the log at ``path``; no such path: none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return parse(spark.read.text(path), schema)


def query_log(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schemas.QUERY_LOG)


def eval_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of the log with their ``place`` in it (written, file, line), by which the last ones are told."""
    place = "place struct<written: timestamp, file: string, line: bigint>"
    if not exists(spark, path):
        return spark.createDataFrame([], f"{place}, {schemas.EVAL_RUN}")
    lines = numbered(spark, path).select("value", F.struct("written", "file", "line").alias("place"))
    return parse(lines, schemas.EVAL_RUN, keep=("place",))


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items (question, expected_sources, expected_keywords), one JSON object a line; items without a question are passed over."""
    return read(spark, path, schemas.EVAL_ITEM).where(F.coalesce("question", F.lit("")) != "")
