"""Structured Streaming forms: live query metrics and continuous sync. Both go beyond the batch engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera import schemas
from tessera.functions import text as T
from tessera.sources import logs


def log_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """The query log as it grows; broken lines are passed over. ``ts`` is the record's time."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path)
    return logs.parse(lines, schemas.QUERY_LOG).withColumn("ts", F.try_to_timestamp("timestamp"))


def windowed(records: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and mean latencies by time window and mode; records later than ``late`` are left out."""
    failed = F.coalesce("error", F.lit(False))
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = records.where("ts IS NOT NULL").withWatermark("ts", late)
    out = rows.groupBy(span.alias("w"), F.coalesce(F.nullif("retrieval_mode", F.lit("")), F.lit("unknown")).alias("mode")).agg(
        F.count("*").alias("total_queries"),
        F.count_if(failed).alias("error_count"),
        T.mean(F.coalesce("total_latency_ms", F.lit(0.0))).alias("avg_total_latency_ms"),
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mode", "total_queries", "error_count", "avg_total_latency_ms")


_NUMBERS = ("retrieval_latency_ms", "generation_latency_ms", "prompt_tokens_estimate", "completion_tokens_estimate")
_STATE = "queries long, errors long, hits long, total double, values array<double>, counts array<long>, sums array<double>, filled array<long>"
_SUMMARY = (
    "start timestamp, end timestamp, mode string, total_queries long, error_count long, error_rate double, hit_rate double, avg_retrieval_latency_ms double, avg_generation_latency_ms double, "
    "avg_total_latency_ms double, avg_prompt_tokens double, avg_completion_tokens double, p50_total_latency_ms double, p95_total_latency_ms double"
)


def summaries(records: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """The summary of ``telemetry.summary`` for each time window: a row for each mode, and one of all (mode null), once no record of the window can come any more.

    The state of a window and mode is sums, and how often each latency came, so the percentiles are exact; it goes when the
    window is told. Records later than ``late`` are left out.
    """
    mode = F.coalesce(F.nullif("retrieval_mode", F.lit("")), F.lit("unknown"))
    rows = records.where("ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("ts", F.window("ts", window).alias("w"), F.explode(F.array(mode, F.lit(None).cast("string"))).alias("mode"), "error", "hit_count", "total_latency_ms", *_NUMBERS)
    rows = rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mode", "ts", "error", "hit_count", "total_latency_ms", *_NUMBERS)
    return rows.groupBy("start", "end", "mode").applyInPandasWithState(_window_state, _SUMMARY, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _window_state(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add rows to a window's state, or tell it when its time is over."""
    if state.hasTimedOut:
        yield pd.DataFrame([(*key, *_told(state.get))], columns=[f.split()[0] for f in _SUMMARY.split(", ")])
        state.remove()
        return
    queries, errors, hits, total, values, counts, sums, filled = state.get if state.exists else (0, 0, 0, 0.0, [], [], [0.0] * 4, [0] * 4)
    seen, sums, filled = dict(zip(values, counts)), list(sums), list(filled)
    for rows in parts:
        failed = rows["error"].eq(True)
        queries, errors = queries + len(rows), errors + int(failed.sum())
        hits += int((~failed & (rows["hit_count"].fillna(0) > 0)).sum())
        latencies = rows["total_latency_ms"].fillna(0.0).astype(float)
        total += float(latencies.sum())
        for v, n in latencies.value_counts().items():
            seen[v] = seen.get(v, 0) + int(n)
        for i, name in enumerate(_NUMBERS):
            # retrieval counts for failures too
            own = (rows[name] if i == 0 else rows[name][~failed]).dropna()
            sums[i], filled[i] = sums[i] + float(own.sum()), filled[i] + len(own)
    state.update((queries, errors, hits, total, list(seen), list(seen.values()), sums, filled))
    state.setTimeoutTimestamp(max(int(key[1].timestamp() * 1000), state.getCurrentWatermarkMs() + 1))


def _told(held: tuple) -> tuple:
    """The metrics of a state, in the order of the summary; nothing to divide by: 0."""
    queries, errors, hits, total, values, counts, sums, filled = held

    def mean(x: float, n: int, digits: int = 2) -> float:
        return round(x / n, digits) if n else 0.0

    def rank(share: float) -> float:
        left = min(int(queries * share), queries - 1)
        for v, n in sorted(zip(values, counts)):
            left -= n
            if left < 0:
                return v
        return 0.0

    numbers = [mean(x, n) for x, n in zip(sums, filled)]
    return (queries, errors, mean(errors, queries, 4), mean(hits, queries - errors, 4), numbers[0], numbers[1], mean(total, queries), numbers[2], numbers[3], rank(0.5), rank(0.95))


def sync_stream(files: DataFrame, apply: Callable[[DataFrame], object], checkpoint: str):
    """Start a query that gives each micro-batch of file rows to ``apply`` (an engine's partial sync)."""
    return files.writeStream.foreachBatch(lambda batch, _: apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
