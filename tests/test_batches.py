"""Models in batches, and evaluation by all modes as one plan."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.engine import Engine
from tessera.operators import batches, keyword, retrieval
from tessera.plans import queries

TEXTS = {1: "alpha one", 2: "beta two", 3: "gamma three", 4: "delta four", 5: "boom", 6: "alpha six"}


def counting(folder, scores):
    """A loader that leaves a file a load, of a model that leaves one a batch and fails on ``boom``."""

    def load():
        open(os.path.join(folder, f"load-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def score(pairs):
            open(os.path.join(folder, f"batch-{len(pairs)}-{uuid.uuid4().hex}"), "w").close()
            if any("boom" in t for _, t in pairs):
                raise RuntimeError("no")
            return [scores(q, t) for q, t in pairs]

        return score

    return load


def files(folder, start):
    return [n.split("-") for n in os.listdir(folder) if n.startswith(start)]


@pytest.fixture
def rows(spark):
    corpus = spark.createDataFrame(list(TEXTS.items()), "key long, text string")
    asked = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "query_id long, text string")
    ranking = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 5, 1), (1, 6, 2), (2, 4, 1), (2, 6, 2)], "query_id long, key long, rank int")
    return ranking.coalesce(1), asked, corpus.coalesce(1)


def order(df):
    return {q: [r.key for r in sorted(df.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 1, 2)}


def test_a_model_scores_batches_and_is_loaded_once_a_worker(rows, tmp_path):
    scorer = batches.BatchScorer(counting(str(tmp_path), lambda q, t: float(len(t))), batch=2)
    df = retrieval.rerank(*rows, 3, scorer)
    want = {0: [3, 1, 2], 1: [5, 6], 2: [4, 6]}
    assert order(df) == want == order(df)
    loads = files(tmp_path, "load")
    assert len(loads) == len({pid for _, pid, _ in loads})  # once in each process, though both runs have several tasks
    assert all(int(n) <= 2 for _, n, _ in files(tmp_path, "batch")) and len(files(tmp_path, "batch")) >= 4
    assert {r.key: r.score for r in df.collect() if r.query_id == 0} == {1: 9.0, 2: 8.0, 3: 11.0}


def test_a_failed_batch_leaves_its_queries_in_order(rows, tmp_path):
    scorer = batches.BatchScorer(counting(str(tmp_path), lambda q, t: -float(t.startswith("alpha"))), batch=1)
    # query 1 has the text that fails: its order stays whole; the others' ties keep their order
    assert order(retrieval.rerank(*rows, 3, scorer)) == {0: [2, 3, 1], 1: [5, 6], 2: [4, 6]}
    everything = batches.BatchScorer(lambda: lambda pairs: [1.0] * (len(pairs) + 1))
    assert order(retrieval.rerank(*rows, 3, everything)) == {0: [1, 2, 3], 1: [5, 6], 2: [4, 6]}
    bad = batches.BatchScorer(lambda: lambda pairs: [float("nan") for _ in pairs])
    assert order(retrieval.rerank(*rows, 2, bad)) == {0: [1, 2], 1: [5, 6], 2: [4, 6]}


def test_replies_are_repeated_and_fail_alone(spark, tmp_path):
    folder = str(tmp_path)

    def model(prompt):
        if prompt == "never":
            raise ValueError("broken")
        if prompt == "second" and not os.path.exists(f"{folder}/tried"):
            open(f"{folder}/tried", "w").close()
            raise ValueError("once")
        return iter([prompt, "!"])

    df = spark.createDataFrame([(1, "first"), (2, "second"), (3, "never"), (4, None)], "id long, prompt string").coalesce(1)
    got = {r.id: (r.reply, r.failure) for r in batches.written(df, lambda: model).collect()}
    assert got == {1: ("first!", None), 2: ("second!", None), 3: ("", "ValueError: broken"), 4: ("", "no prompt")}


def test_all_modes_equal_each_alone_and_read_the_corpus_once(spark, small):
    docs = queries._corpus(spark, small)
    asked, index = queries._asked(spark, small), keyword.build(docs, "doc_id")
    found = retrieval.by_mode(asked, docs, key="doc_id", unit=True, index=index)
    got = {m: sorted((r.query_id, r["rank"], r.doc_id) for r in found.where(F.col("mode") == m).collect()) for m in config.MODES}
    for m in config.MODES:
        assert got[m] == sorted((r.query_id, r["rank"], r.doc_id) for r in retrieval.retrieve(asked, docs, m, key="doc_id", unit=True, index=index).collect()), m
    plan = found.where("mode <> 'hybrid_rerank'")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMap" not in plan and "MapInArrow" not in plan  # the one vector pass is a checkpoint that all share


def test_answers_are_scored_by_mode(spark, tmp_path):
    s = config.Settings(warehouse=str(tmp_path / "w"), query_log=str(tmp_path / "q"), eval_log=str(tmp_path / "e"), top_k=2)
    engine = Engine(spark, s, model=lambda p: "login here" if "login(" in p.split("Question")[0] else "no idea")
    engine.index_uploads("app", [("auth.py", b"def login(user):\n    return user\n"), ("mail.py", b"def send(to):\n    return to\n"), ("z.md", b"other words")])
    items = [("login user", ["auth.py"], ["login"]), ("send to", ["mail.py"], ["absent"])]
    got = engine.evaluate("app", items, score_answers=True, judge=lambda p: '{"verdict": "correct"}' if "login here" in p else 1 / 0)
    assert set(got) == set(config.MODES) and all(set(v) == {"retrieval", "answers", "judge"} for v in got.values())
    assert got["hybrid"]["retrieval"]["hit_rate"] == 1.0 and got["hybrid"]["answers"]["keyword_hit_rate"] == 0.5
    assert got["hybrid"]["judge"]["correct"] + got["hybrid"]["judge"]["error"] == 2.0
