"""The engine: collections, indexing, retrieval, answers, metrics, evaluation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config, qa
from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.operators import batches, chunking, embed, evaluate, retrieval, summaries, sync, telemetry
from tessera.sources import files as sources
from tessera.sources import logs
from tessera.sources.catalog import Catalog
from tessera.sources.scratch import saved


class Engine:
    """Everything a client does. Models are callables given by it: ``embedder`` texts to vectors, ``model`` prompt to answer."""

    def __init__(self, spark: SparkSession, settings: config.Settings = config.Settings(), embedder: embed.Embedder | None = None, model: Callable | None = None, scorer: retrieval.Scorer | None = retrieval.lexical) -> None:
        self.spark, self.settings = spark, settings
        self.embedder = embedder or embed.hashing_embedder(settings.embedding_dim)
        self.model, self.scorer = model, scorer
        self.catalog = Catalog(spark, settings.warehouse, settings.vector_index)

    def health(self, probe: str | None = None) -> dict:
        """What works: Spark, the warehouse, the embedder, whether there is a model, and with a ``probe`` text whether the model answers it.

        The status is ``ok``, or ``degraded`` with the failures by name.
        """
        failures = {}

        def works(name: str, check: Callable) -> bool:
            try:
                return bool(check())
            except Exception as e:
                failures[name] = f"{type(e).__name__}: {e}"
                return False

        def answers() -> bool:
            reply = self.model(probe)
            return bool(reply if isinstance(reply, str) else "".join(reply))

        out = {
            "spark": self.spark.version,
            "model": self.model is not None,
            "embedder": works("embedder", lambda: len(self.embedder(["probe"])[0]) > 0),
            "warehouse": works("warehouse", lambda: self.catalog.names() is not None),
        }
        if probe is not None:
            out["answers"] = self.model is not None and works("model", answers)
        good = all(v for k, v in out.items() if k != "model")
        return {"status": "ok" if good else "degraded", **out, **({"failures": failures} if failures else {})}

    # -- collections

    def list_collections(self) -> list[dict]:
        return self.catalog.list()

    def drop(self, name: str) -> bool:
        return self.catalog.drop(name)

    def sources(self, name: str) -> list[str]:
        return [r[0] for r in self.catalog.sources(name).collect()]

    def symbols(self, name: str) -> list[str]:
        return [r[0] for r in self.catalog.symbols(name).collect()]

    @staticmethod
    def collection_name(spark: SparkSession, name: str) -> str:
        if not name or not name.strip():
            raise ValueError("the project has no name")
        return spark.range(1).select(P.collection_name(F.lit(name))).first()[0]

    # -- indexing

    def index_zip(self, name: str, path: str) -> dict:
        """An archive is a whole project: files that it lacks go."""
        if not path.lower().endswith(".zip"):
            raise ValueError("the archive's name ends in .zip")
        return self.sync(name, sources.from_zip(self.spark, path, self.settings), full_sync=True)

    def index_uploads(self, name: str, uploads: list[tuple[str, bytes]]) -> dict:
        """Uploads of an archive are a whole project, single files are a part of one."""
        whole = any(n.endswith(".zip") for n, _ in uploads)
        return self.sync(name, sources.from_uploads(self.spark, uploads, self.settings), full_sync=whole)

    def index_directory(self, name: str, root: str, full_sync: bool = False) -> dict:
        return self.sync(name, sources.from_directory(self.spark, root, self.settings.respect_gitignore), full_sync)

    def sync(self, name: str, files: DataFrame, full_sync: bool = False) -> dict:
        """Bring a collection up to date with file rows; only new and changed files are chunked and embedded.

        What is written is the new chunks and a list of those that they replace; readers see all of that or nothing, and
        writers at the same time lose no rows (see ``Catalog``).
        """
        began = time.perf_counter()
        name = self.collection_name(self.spark, name)
        own = sync.first_by(files.withColumn("hash", T.content_hash("content")), ["path"], ["hash"]).persist()
        try:
            old = self.catalog.create(name)
            found = sync.diff(own.select("path", "hash"), sync.stored_hashes(old), full_sync).persist()
            counts = sync.stats(found).first().asDict()
            total = summaries.file_summary(own).first().asDict()
            made = 0
            if counts["files_new"] + counts["files_updated"] + counts["files_deleted"]:
                fresh = own.join(found.where(F.col("status").isin("new", "updated")), "path", "left_semi")
                chunks = embed.embed_distinct(chunking.ingest(fresh, self.settings), self.embedder, self.settings.embedding_batch_size)
                changed = found.where("status <> 'unchanged'").select(F.col("path").alias("source"))
                made = self.catalog.add(name, chunks, changed)
            found.unpersist()
        finally:
            own.unpersist()
        return {"collection": name, **counts, **total, "chunks": made, "collection_chunks": self.catalog.count(name), "seconds": round(time.perf_counter() - began, 2)}

    def _keyed(self, name: str) -> DataFrame:
        """The chunks of a collection with the columns that retrieval looks for."""
        return self.catalog.keyed(name).withColumn("text", F.col("page_content"))

    # -- retrieval and answers

    def retrieve(self, collection: str, question: str, mode: str | None = None, language: str | None = None, source: str | None = None, symbol: str | None = None, phrasings: Sequence[str] = ()) -> DataFrame:
        """The chunks found for a question, with score and rank; a missing collection has none."""
        return self.retrieve_many(collection, [(0, question)], mode, language, source, symbol, [(0, i, p) for i, p in enumerate(phrasings, 1)])

    def retrieve_many(self, collection: str, questions: list[tuple[int, str]], mode: str | None = None, language: str | None = None, source: str | None = None, symbol: str | None = None, phrasings: Sequence[tuple[int, int, str]] = ()) -> DataFrame:
        """The chunks found for each (query_id, question), by one plan for all of them."""
        corpus = self._keyed(collection)
        index, near = self.catalog.words(collection), self.catalog.vector_index(collection)
        vectors = self.embedder([q for _, q in questions])
        asked = self.spark.createDataFrame([(i, q, v) for (i, q), v in zip(questions, vectors)], "query_id long, text string, embedding array<float>")
        variants = None
        if phrasings:
            more = self.embedder([p for *_, p in phrasings])
            variants = self.spark.createDataFrame([(i, n, p, v) for (i, n, p), v in zip(phrasings, more)], "query_id long, variant int, text string, embedding array<float>")
        found = retrieval.retrieve(asked, corpus, mode or self.settings.retrieval_mode, self.settings, "key", "text", language, source, symbol, variants, self.scorer, index=index, near=near)
        return found.join(corpus.drop("embedding", "text"), "key").drop("key")

    def stream(self, collection: str, question: str, history: Sequence[dict] | None = None, **how) -> Iterator[dict]:
        """Events of an answer, see ``qa.answer``."""
        if self.model is None:
            raise ValueError("no model was given")
        if not self.catalog.exists(collection):
            raise KeyError(collection)
        return qa.answer(self, collection, question, self.model, history, **how)

    def query(self, collection: str, question: str, history: Sequence[dict] | None = None, **how) -> dict:
        """The whole answer, its sources and metrics; an error event raises."""
        out: dict = {"answer": "", "sources": [], "metrics": {}}
        for e in self.stream(collection, question, history, **how):
            if e["type"] == "error":
                raise RuntimeError(e["message"])
            if e["type"] == "token":
                out["answer"] += e["content"]
            elif e["type"] == "sources":
                out["sources"] = e["sources"]
            else:
                out["metrics"] = {k: v for k, v in e.items() if k != "type"}
        return out

    # -- telemetry and evaluation

    def metrics(self, since_minutes: int | None = None, collection: str | None = None) -> DataFrame:
        """The summary of the query log, overall and by mode."""
        if since_minutes is not None and since_minutes <= 0:
            raise ValueError("since_minutes is above 0")
        after = None
        if since_minutes is not None:
            after = self.spark.range(1).select(F.current_timestamp() - F.make_dt_interval(mins=F.lit(since_minutes))).first()[0]
        return telemetry.summary(telemetry.since(logs.query_log(self.spark, self.settings.query_log), after, collection))

    def evaluate(self, collection: str, items: list[tuple] | DataFrame, modes: Sequence[str] = config.MODES, record: bool = True, score_answers: bool = False, judge: qa.Model | None = None) -> dict:
        """Quality by mode of items (question, expected sources[, expected keywords]), a list or a table such as ``logs.eval_items`` reads.

        All questions and modes are one plan, which shares the vector and the keyword ranking. ``score_answers`` has the model
        answer each question by each mode and scores its keywords; ``judge`` is a model that grades the answers. Both run in
        tasks, so they are sent there; a call that fails is repeated once, then the answer is empty (and the verdict ``error``).
        """
        if isinstance(items, DataFrame):
            items = [(r[0], r[1] or [], r[2] or []) for r in items.select("question", "expected_sources", "expected_keywords").collect()]
        k, modes = self.settings.top_k, tuple(modes)
        make = self.spark.createDataFrame
        truth = make([(i, s) for i, x in enumerate(items) for s in sorted(set(x[1]))], "query_id long, key string")
        every = make([(i, x[0], list(x[2]) if len(x) > 2 else []) for i, x in enumerate(items)], "query_id long, question string, keywords array<string>")
        corpus, vectors = self._keyed(collection), self.embedder([x[0] for x in items])
        asked = make([(i, x[0], v) for i, (x, v) in enumerate(zip(items, vectors))], "query_id long, text string, embedding array<float>")
        found = retrieval.by_mode(asked, corpus, modes, self.settings, "key", "text", self.scorer, index=self.catalog.words(collection))
        found = found.join(corpus.select("key", "source", "page_content"), "key")
        once = sync.first_by(found.select("mode", "query_id", F.col("source").alias("key"), "rank"), ["mode", "query_id", "key"], ["rank"])
        ranks = once.withColumn("rank", F.row_number().over(retrieval.Window.partitionBy("mode", "query_id").orderBy("rank")))
        scored = evaluate.per_query(evaluate.each_mode(ranks), evaluate.each_mode(truth, modes), k, evaluate.each_mode(every.select("query_id"), modes))
        parts = {"retrieval": evaluate.aggregate(scored.withColumn("mode", F.col("query_id.mode")), "mode")}
        if score_answers or judge:
            texts = retrieval.context(evaluate.each_mode(found.select("mode", "query_id", "key", "rank")), corpus.select("key", "text"))
            asks = evaluate.each_mode(every, modes).join(texts, "query_id", "left").withColumn("prompt", qa.prompt_of(F.col("context"), F.col("question"))).drop("context")
            model = self.model
            replies = saved(batches.written(asks, lambda: model).select(F.col("query_id.mode").alias("mode"), "question", "keywords", F.col("reply").alias("answer")))
            parts["answers"] = evaluate.aggregate_answers(evaluate.answers(replies), "mode")
            if judge:
                grades = batches.written(replies.select("mode", qa.filled(qa.JUDGE, question=F.col("question"), answer=F.col("answer")).alias("prompt")), lambda: judge)
                parts["judge"] = evaluate.aggregate_judgements(grades.select("mode", T.judge_response("reply").alias("j")).select("mode", "j.*"), "mode")
        results: dict = {m: {} for m in modes}
        for section, rows in parts.items():
            for r in rows.collect():
                results[r["mode"]][section] = {m: float(v) for m, v in r.asDict().items() if m not in ("n", "mode")}
        if record:
            evaluate.record_run(self.spark, self.settings.eval_log, k, len(items), results, self.settings)
        return results

    def last_diff(self, mode: str) -> DataFrame:
        """(section, metric, current, previous, delta) of the last two runs that had ``mode``."""
        runs = logs.eval_runs(self.spark, self.settings.eval_log).where(F.col("results").getItem(mode).isNotNull())
        runs = runs.orderBy(*evaluate.logs_order(runs)).limit(2).collect()
        schema = "section string, metric string, value double"

        def rows(r) -> DataFrame:
            return self.spark.createDataFrame([(s, m, v) for s, x in r["results"][mode].items() for m, v in x.items()], schema)

        return evaluate.diff(rows(runs[0]), rows(runs[1]) if len(runs) > 1 else self.spark.createDataFrame([], schema)) if runs else evaluate.diff(self.spark.createDataFrame([], schema), self.spark.createDataFrame([], schema))
