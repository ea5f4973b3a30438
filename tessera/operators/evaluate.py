"""Retrieval and answer quality, and the history of evaluation runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import config, schemas
from tessera.functions import text as T

METRICS = ("precision_at_k", "recall_at_k", "reciprocal_rank", "hit")


def per_query(ranking: DataFrame, truth: DataFrame, k: int, queries: DataFrame | None = None, key: str = "key") -> DataFrame:
    """(query_id, precision_at_k, recall_at_k, reciprocal_rank, hit) of ranking (query_id, key, rank) against truth (query_id, key).

    Precision divides by the rows found in the first ``k``, which may be fewer; the
    reciprocal rank looks at the whole ranking. ``queries`` adds those without any row, as zeros.
    """
    right = truth.select("query_id", key).distinct()
    rows = ranking.select("query_id", key, "rank").join(right.withColumn("right", F.lit(True)), ["query_id", key], "left")
    return _scored(rows, right.groupBy("query_id").agg(F.count("*").alias("wanted")), k, queries)


def per_query_by_label(ranking: DataFrame, labels: DataFrame, asked: DataFrame, k: int, key: str = "key") -> DataFrame:
    """As ``per_query``, where what is right for a query (query_id, label) is every row (key, label) of its label.

    The rows of a label are counted, not paired with its queries: only what was found is looked up.
    """
    own = labels.where("label IS NOT NULL")
    wanted = asked.join(own.groupBy("label").agg(F.count("*").alias("wanted")), "label").select("query_id", "wanted")
    found = ranking.select("query_id", key, "rank").join(own.select(key, F.col("label").alias("has")), key, "left").join(asked, "query_id", "left")
    return _scored(found.select("query_id", "rank", (F.col("has") == F.col("label")).alias("right")), wanted, k, asked)


def _scored(rows: DataFrame, wanted: DataFrame, k: int, queries: DataFrame | None) -> DataFrame:
    """Metrics of rows (query_id, rank, right) and wanted (query_id, wanted)."""
    top, right = F.col("rank") <= k, F.coalesce(F.col("right"), F.lit(False))
    found = rows.groupBy("query_id").agg(F.count_if(top).alias("n"), F.count_if(top & right).alias("hits"), F.min(F.when(right, F.col("rank"))).alias("first"))
    every = (queries.select("query_id").distinct() if queries is not None else found.select("query_id")).join(found, "query_id", "left").join(wanted, "query_id", "left")

    def share(a: str, b: str):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    rr = F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))
    return every.select("query_id", share("hits", "n").alias("precision_at_k"), share("hits", "wanted").alias("recall_at_k"), rr.alias("reciprocal_rank"), (F.coalesce("hits", F.lit(0)) > 0).alias("hit"))


def aggregate(rows: DataFrame, *by: str) -> DataFrame:
    """Means of ``per_query`` rows rounded to 4, and n; nothing: zeros."""

    def mean(c: str):
        return F.coalesce(T.rounded(F.avg(F.col(c).cast("double")), 4), F.lit(0.0))

    made = (mean("precision_at_k").alias("precision_at_k"), mean("recall_at_k").alias("recall_at_k"), mean("reciprocal_rank").alias("mrr"), mean("hit").alias("hit_rate"), F.count("*").alias("n"))
    return rows.groupBy(*by).agg(*made) if by else rows.agg(*made)


def each_mode(rows: DataFrame, modes: tuple[str, ...] | None = None) -> DataFrame:
    """``rows`` with the mode in their query_id: they have one, or get each of ``modes``."""
    own = rows if modes is None else rows.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    return own.withColumn("query_id", F.struct("mode", "query_id")).drop("mode")


def answers(rows: DataFrame, answer: str = "answer", keywords: str = "keywords", least: float = 0.5) -> DataFrame:
    """``rows`` with keyword_coverage and keyword_hit."""
    return rows.withColumns({"keyword_coverage": T.keyword_coverage(answer, keywords), "keyword_hit": T.keyword_hit(answer, keywords, least)})


def aggregate_answers(rows: DataFrame, *by: str) -> DataFrame:
    scored = F.coalesce(T.rounded(F.avg("keyword_coverage"), 4), F.lit(0.0)).alias("keyword_coverage"), F.coalesce(T.rounded(F.avg(F.col("keyword_hit").cast("double")), 4), F.lit(0.0)).alias("keyword_hit_rate")
    return rows.groupBy(*by).agg(*scored, F.count("*").alias("n"))


def aggregate_judgements(rows: DataFrame, *by: str) -> DataFrame:
    """Mean score and a count of each verdict of rows (verdict, score)."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in (*config.VERDICTS, "error")]
    return rows.groupBy(*by).agg(F.coalesce(T.rounded(F.avg("score"), 4), F.lit(0.0)).alias("score"), *counts, F.count("*").alias("n"))


def previous(runs: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """``runs`` with the last earlier value of each of ``values`` within ``by``, as previous_*."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("*", *(F.last(v, ignorenulls=True).over(before).alias(f"previous_{v}") for v in values))


def unpivot(results: DataFrame, column: str = "results") -> DataFrame:
    """(mode, section, metric, value) of a column of nested maps."""
    modes = results.select(F.explode(column).alias("mode", "_s"))
    return modes.select("mode", F.explode("_s").alias("section", "_m")).select("mode", "section", F.explode("_m").alias("metric", "value"))


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(section, metric, current, previous, delta) of metrics that both sides (section, metric, value) have; delta rounded to 4."""
    both = now.select("section", "metric", F.col("value").alias("current")).join(before.select("section", "metric", F.col("value").alias("previous")), ["section", "metric"])
    return both.where("current IS NOT NULL AND previous IS NOT NULL").withColumn("delta", T.rounded(F.col("current") - F.col("previous"), 4))


def record_run(spark: SparkSession, path: str, k: int, n: int, results: dict[str, dict[str, dict[str, float]]], settings: config.Settings) -> None:
    """Append a run with its settings, as a file of its own."""
    names = ("chunk_size", "chunk_overlap", "top_k", "fetch_k", "mmr_lambda", "rrf_k", "retrieval_mode", "embedding_batch_size", "embedding_dim", "enable_query_rewrite", "history_turns", "enable_query_expansion", "query_expansion_count")
    kept = {x: str(getattr(settings, x, None)) for x in names}
    stamp = dt.datetime.now(dt.timezone.utc).isoformat(timespec="milliseconds")
    spark.createDataFrame([(stamp, k, n, kept, results)], schemas.EVAL_RUN).coalesce(1).write.mode("append").json(path)


def logs_order(runs: DataFrame) -> list:
    """The last run first: by its place in the log if that is told, else by its time."""
    return [F.col("place").desc()] if "place" in runs.columns else [F.col("timestamp").desc()]


def history(runs: DataFrame, last: int) -> DataFrame:
    """(timestamp, mode, section, metric, value) of the last ``last`` runs."""
    recent = runs.orderBy(*logs_order(runs)).limit(last)
    return recent.select("timestamp", F.explode("results").alias("mode", "_s")).select("timestamp", "mode", F.explode("_s").alias("section", "_m")).select("timestamp", "mode", "section", F.explode("_m").alias("metric", "value"))


def _table(head: list[str], rows: list[list]) -> str:
    cells = [head, *([("-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)) for x in r] for r in rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(head))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in cells)


def report(results: dict[str, dict[str, dict[str, float]]]) -> str:
    """A text table of one run: a line for each mode, a column for each metric."""
    names = list(dict.fromkeys((s, m) for x in results.values() for s, v in x.items() for m in v))
    return _table(["mode", *(f"{s}.{m}" for s, m in names)], [[mode, *(x.get(s, {}).get(m) for s, m in names)] for mode, x in results.items()])


def diff_report(rows: DataFrame) -> str:
    """A text table of ``diff``."""
    names = ["section", "metric", "current", "previous", "delta"]
    return _table(names, [list(r) for r in rows.select(*names).orderBy("section", "metric").collect()])


def history_report(runs: DataFrame, last: int) -> str:
    """A text table of the last runs, the oldest first: a line for each run and mode."""
    rows = history(runs, last).groupBy("timestamp", "mode").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "section", "metric"), "value"))).alias("m")).orderBy("timestamp", "mode").collect()
    names = sorted({n for r in rows for n in r["m"]})
    return _table(["timestamp", "mode", *names], [[r["timestamp"], r["mode"], *(r["m"].get(n) for n in names)] for r in rows])
