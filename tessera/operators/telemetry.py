"""Query telemetry: a log of numbers, never of questions, answers or texts, and its summary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as T
from tessera.operators.ranks import nearest_ranks


def since(records: DataFrame, after: str | dt.datetime | None = None, collection: str | None = None) -> DataFrame:
    """Records not older than ``after`` (those without a readable time are left out then) and of ``collection``."""
    out = records
    if after is not None:
        out = out.where(F.try_to_timestamp("timestamp") >= F.lit(after).cast("timestamp"))
    return out if collection is None else out.where(F.col("collection") == collection)


def _metrics() -> list[Column]:
    failed = F.coalesce(F.col("error"), F.lit(False))
    total = F.coalesce("total_latency_ms", F.lit(0.0))

    def ok(c: str) -> Column:
        return F.when(~failed, F.col(c))

    return [
        F.count("*").alias("total_queries"),
        F.count_if(failed).alias("error_count"),
        F.coalesce(T.rounded(F.try_divide(F.count_if(failed).cast("double"), F.count("*").cast("double")), 4), F.lit(0.0)).alias("error_rate"),
        F.coalesce(T.rounded(F.try_divide(F.count_if(~failed & (F.coalesce("hit_count", F.lit(0)) > 0)).cast("double"), F.count_if(~failed).cast("double")), 4), F.lit(0.0)).alias("hit_rate"),
        T.mean("retrieval_latency_ms").alias("avg_retrieval_latency_ms"),
        T.mean(ok("generation_latency_ms")).alias("avg_generation_latency_ms"),
        T.mean(total).alias("avg_total_latency_ms"),
        T.mean(ok("prompt_tokens_estimate")).alias("avg_prompt_tokens"),
        T.mean(ok("completion_tokens_estimate")).alias("avg_completion_tokens"),
    ]


def summary(records: DataFrame) -> DataFrame:
    """One row overall (mode null) and one for each mode; no record: the overall row, all zeros.

    Hit rate, generation latency and tokens are over successes, the rest over all records. A
    record without a mode is of mode ``unknown``.
    """
    rows = records.select("*", F.coalesce(F.nullif("retrieval_mode", F.lit("")), F.lit("unknown")).alias("_mode"), F.coalesce("total_latency_ms", F.lit(0.0)).alias("_total"))
    shares = {"p50_total_latency_ms": 0.5, "p95_total_latency_ms": 0.95}
    overall = rows.agg(*_metrics()).crossJoin(F.broadcast(nearest_ranks(rows, "_total", shares))).withColumn("_mode", F.lit(None).cast("string"))
    by_mode = rows.groupBy("_mode").agg(*_metrics()).join(nearest_ranks(rows, "_total", shares, ("_mode",)), "_mode")
    return overall.unionByName(by_mode).fillna(0.0, list(shares)).withColumnRenamed("_mode", "mode")


def record(spark: SparkSession, path: str, **values) -> None:
    """Append one record, as a file of its own, so writers need no lock; an unknown field is an error."""
    fields = [x.split()[0] for x in schemas.QUERY_LOG.split(", ")]
    if unknown := set(values) - set(fields):
        raise ValueError(f"no field of the log: {', '.join(sorted(unknown))}")
    row = {"timestamp": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")} | values
    spark.createDataFrame([tuple(row.get(f) for f in fields)], schemas.QUERY_LOG).coalesce(1).write.mode("append").json(path)
