import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.operators import embed, evaluate, keyword, keyword_batch, retrieval, vector

DOCS = [
    (1, "a.py", "find user by id in the database"), (2, "b.py", "parse config file"), (3, "c.py", "render html page"),
    (4, "d.py", "send mail to customer"), (5, "e.py", "get_user_by_id returns a user"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    e = embed.hashing_embedder(32)
    return spark.createDataFrame([(i, s, t, "en" if i % 2 else "fr", v) for (i, s, t), v in zip(DOCS, e([t for *_, t in DOCS]))], "key long, source string, text string, language string, embedding array<float>")


def asked(spark, *questions):
    e = embed.hashing_embedder(32)
    return spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(zip(questions, e(list(questions))))], "query_id long, text string, embedding array<float>")


def ranked(df, q=0, key="key"):
    return [r[key] for r in sorted(df.collect(), key=lambda r: r["rank"]) if r.query_id == q]


def okapi(docs, query, k1=1.5, b=0.75):
    toks = {i: t.split() for i, t in docs.items()}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}
    return {i: sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / mean)) for w in query.split()) for i, t in toks.items()}


def test_bm25_scores(spark):
    docs = {1: "a b c", 2: "a a d", 3: "a e", 4: "a b", 5: "f g h i"}
    df = spark.createDataFrame(list(docs.items()), "key long, text string")
    q = spark.createDataFrame([(0, "b a b zz"), (1, "f"), (2, ""), (3, None)], "query_id long, text string")
    rows = keyword.search(q, keyword.index(df), 10).collect()
    for i, text in ((0, "b a b zz"), (1, "f")):
        want = {k: round(v, 6) for k, v in okapi(docs, text).items() if round(v, 6) > 0}
        assert {r.key: r.score for r in rows if r.query_id == i} == pytest.approx(want)
    assert {r.query_id for r in rows} == {0, 1}


def zipf(spark, n=1500, seed=0, words=400):
    """Documents of words by Zipf's law, with rare ones and repeated documents."""
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, words + 1)
    texts = [" ".join(f"w{x}" for x in rng.choice(words, rng.integers(1, 60), p=p / p.sum())) for _ in range(n - 20)] + ["w1 w2 w3"] * 20
    return spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(4)


def test_blocks_are_passed_over_without_loss(spark, tmp_path, monkeypatch):
    corpus = zipf(spark)
    q = spark.createDataFrame([(0, "w300 w399"), (1, "w0 w1"), (2, "w0 w350 w350 w7"), (3, " ".join(f"w{i}" for i in range(200))), (4, "absent"), (5, None), (6, "w1 w2 w3")], "query_id long, text string")
    monkeypatch.setattr(keyword, "BLOCK", 8)
    monkeypatch.setattr(keyword, "FIRST", 12)
    keyword.write(keyword.build(corpus), str(tmp_path))
    kept = keyword.read(spark, str(tmp_path))
    for k in (1, 5, 40):
        want = sorted(keyword.search(q, keyword.index(corpus), k).collect())
        assert sorted(keyword.search(q, kept, k).collect()) == want
    rows = {r.query_id: r for r in keyword.reads(q, kept, 5).collect()}
    assert set(rows) == {0, 1, 2, 3, 6} and all(r.postings_scored <= r.postings and r.blocks_scored <= r.blocks for r in rows.values())
    assert rows[2].postings_scored < 0.5 * rows[2].postings and sum(r.postings_scored for r in rows.values()) < sum(r.postings for r in rows.values())


def test_bounds_hold(spark, tmp_path, monkeypatch):
    """No document of a block scores above the block's bound."""
    monkeypatch.setattr(keyword, "BLOCK", 16)
    corpus = zipf(spark, 600, 3)
    index = keyword.build(corpus)
    q = spark.createDataFrame([(0, "w0 w5 w9 w9"), (1, "w250 w1")], "query_id long, text string")
    waves = keyword._waves(q, index, 3, 6)
    bounds = {(r.query_id, r.block): r.bound for r in waves.bounds.collect()}
    block = {r.key: r.block for r in index.blocks.select("block", F.explode("rows.key").alias("key")).distinct().collect()}
    for r in keyword.search(q, keyword.index(corpus), 600).collect():
        assert r.score <= bounds[r.query_id, block[r.key]] + 1e-6


def test_many_queries_score_where_documents_are_read(spark, tmp_path, monkeypatch):
    """A pass in small blocks and parts gives what the join gives, whatever the documents are kept in; no row for each query and document leaves a task."""
    corpus = zipf(spark, 400, 5).union(spark.createDataFrame([(900, None), (901, "")], "key long, text string"))
    q = corpus.where("key % 20 = 0").select(F.struct("key", F.lit(0).alias("variant")).alias("query_id"), "text")
    want = {k: sorted(keyword.search(q, keyword.index(corpus), k).collect()) for k in (1, 7)}
    some = corpus.where("key % 3 = 0")
    want_some = sorted(keyword.search(q, keyword.index(some), 7).collect())
    monkeypatch.setattr(keyword, "BLOCK", 8)
    keyword.write(keyword.build(corpus), str(tmp_path))
    kept = keyword.read(spark, str(tmp_path))
    every = {r.query_id: (r.blocks, r.postings) for r in keyword.reads(q, kept, 400).collect()}
    monkeypatch.setattr(keyword, "JOINED", 0)
    for name, value in (("QUERIES", 6), ("CELLS", 100), ("TOKENS", 90), ("ROWS", 4)):
        monkeypatch.setattr(keyword_batch, name, value)
    for k in (1, 7):
        assert sorted(keyword.search(q, keyword.index(corpus), k).collect()) == want[k]
        assert sorted(keyword.search(q, kept, k).collect()) == want[k]
    assert sorted(keyword.search(q, keyword.index(some), 7).collect()) == want_some
    assert sorted(keyword.search(q, kept.only(some.select("key")), 7).collect()) == want_some
    assert {r.query_id: (r.blocks_scored, r.postings_scored) for r in keyword.reads(q, kept, 5).collect()} == every
    assert keyword.search(q, keyword.index(corpus.limit(0)), 3).count() == 0


def test_bm25_many_query_tokens(spark, corpus, monkeypatch):
    q = asked(spark, "find user by id", "render page")
    want = keyword.search(q, keyword.index(corpus), 5).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(keyword, "VOCABULARY", 2)
    assert keyword.search(q, keyword.index(corpus), 5).orderBy("query_id", "rank").collect() == want
    assert keyword.search(q, keyword.build(corpus), 5).orderBy("query_id", "rank").collect() == want


def test_bm25_order_cap_and_empty(spark, corpus):
    q = asked(spark, "find user by id")
    assert ranked(keyword.search(q, keyword.index(corpus), 10))[0] in (1, 5)
    assert len(ranked(keyword.search(q, keyword.index(corpus), 1))) == 1
    assert keyword.search(q, keyword.index(corpus.limit(0)), 3).count() == 0
    english = keyword.search(q, keyword.index(corpus, where=F.col("language") == "fr"), 5)
    assert set(ranked(english)) <= {2, 4}


def test_kept_index_gives_what_a_scan_gives(spark, corpus, tmp_path):
    keyword.write(keyword.build(corpus), str(tmp_path))
    kept = keyword.read(spark, str(tmp_path))
    q = asked(spark, "find user by id the the")
    for where in (None, F.col("language") == "fr"):
        scan = keyword.index(corpus, where=where)
        part = kept if where is None else kept.only(corpus.where(where).select("key"))
        want = sorted(keyword.search(q, scan, 10).collect())
        assert (want or where is not None) and sorted(keyword.search(q, part, 10).collect()) == want
    assert sorted(keyword.document_frequency(kept).collect()) == sorted(keyword.document_frequency(keyword.index(corpus)).collect())
    plan = kept.blocks.where(F.col("token").isin(["user"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token" in plan or "EqualTo(token,user)" in plan
    assert keyword.search(q, keyword.build(corpus.limit(0)), 3).count() == 0


def test_knn_matches_numpy(spark):
    rng = np.random.default_rng(0)
    m = np.round(rng.normal(size=(80, 5)), 1).astype(np.float32)
    m[10:20] = m[10]
    rows = [(int(i), v.tolist()) for i, v in enumerate(m)] + [(100, None), (101, [1.0]), (102, [0.0] * 5)]
    df = spark.createDataFrame(rows, "key long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(0, m[10].tolist()), (1, m[3].tolist()), (2, None)], "query_id long, embedding array<float>")
    got = vector.knn(q, df, 7).collect()
    for i, v in ((0, m[10]), (1, m[3])):
        v = v.astype(float)
        sim = {k: round(float(x @ v / np.linalg.norm(x) / np.linalg.norm(v)), 6) for k, x in enumerate(m.astype(float))} | {102: 0.0}
        want = sorted(sim, key=lambda k: (-sim[k], k))[:7]
        assert ranked(vector.knn(q, df, 7), i) == want
        assert {r.key: r.score for r in got if r.query_id == i} == pytest.approx({k: sim[k] for k in want})
    assert {r.query_id for r in got} == {0, 1}


def test_more_queries_than_a_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))], "key long, embedding array<float>")
    q = df.where("key < 25").select(F.col("key").alias("query_id"), "embedding")
    want = sorted(vector.knn(q, df, 3).collect())
    monkeypatch.setattr(vector, "LIMIT", 10)
    assert len(want) == 75 and sorted(vector.knn(q, df, 3).collect()) == want


def test_mmr_matches_greedy(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(30, 6)).astype(np.float32)
    m[7] = m[3]
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "key long, embedding array<float>")
    q = spark.createDataFrame([(0, m[3].tolist())], "query_id long, embedding array<float>")
    for weight in (0.0, 0.5, 1.0):
        sims = np.round(unit @ unit[3], 6)
        pool = sorted(range(30), key=lambda i: (-sims[i], i))[:10]
        picked = []
        while len(picked) < 5:
            def worth(i):
                worst = max((round(float(unit[i] @ unit[p]), 6) for p in picked), default=0.0)
                return round(weight * sims[i] - (1 - weight) * worst, 6)
            picked.append(max((i for i in pool if i not in picked), key=lambda i: (worth(i), -pool.index(i))))
        assert ranked(vector.mmr(q, df, 5, 10, weight)) == picked
    assert len(ranked(vector.mmr(q, df.limit(3), 5, 10, 0.5))) == 3


def ranking(spark, *keys):
    return spark.createDataFrame([(0, k, i) for i, k in enumerate(keys, 1)], "query_id long, key string, rank int")


def test_fusion(spark):
    assert ranked(retrieval.fuse([ranking(spark, "a", "b", "c"), ranking(spark, "b", "a")]))[2] == "c"
    assert ranked(retrieval.fuse([ranking(spark, "x", "y", "z")])) == ["x", "y", "z"]
    both = retrieval.fuse([ranking(spark, "a", "b"), ranking(spark, "c", "b")])
    assert ranked(both) == ["b", "a", "c"] and both.where("key = 'b'").first().score == pytest.approx(2 / 62)
    assert ranked(retrieval.fuse([ranking(spark, "a", "b")], k=1)) == ["a"]


def test_rerank(spark, corpus):
    q = asked(spark, "parse config")
    first = spark.createDataFrame([(0, k, i) for i, k in enumerate([1, 4, 2], 1)], "query_id long, key long, rank int").withColumn("score", F.lit(0.0))
    assert ranked(retrieval.rerank(first, q, corpus, 2)) == [2, 1]
    assert ranked(retrieval.rerank(first, q, corpus, 2, scorer=None)) == [1, 4]
    assert ranked(retrieval.rerank(first, q, corpus, 3, scorer=lambda a, b: F.length(b).cast("double"))) == [1, 4, 2]


@pytest.mark.parametrize("mode", [*config.MODES, "unknown"])
def test_modes_and_filters(spark, corpus, mode):
    q = asked(spark, "find user by id", "render page")
    all_ = retrieval.retrieve(q, corpus, mode, config.Settings(top_k=3))
    assert ranked(all_)[0] in (1, 5) and len(ranked(all_)) <= 3 and ranked(all_, 1)[0] == 3
    some = retrieval.retrieve(q, corpus, mode, config.Settings(top_k=3), language="fr")
    assert set(ranked(some)) <= {2, 4} and ranked(retrieval.retrieve(q, corpus, mode, source="c.py")) in ([3], [])


def test_variants(spark, corpus):
    q = asked(spark, "find user by id")
    none = q.select("query_id", F.lit(1).alias("variant"), "text", "embedding").limit(0)
    plain = retrieval.hybrid(q, corpus, 5)
    assert ranked(retrieval.hybrid(q, corpus, 5, variants=none)) == ranked(plain)
    other = asked(spark, "render html page").withColumn("variant", F.lit(1))
    assert 3 in ranked(retrieval.hybrid(q, corpus, 3, variants=other))


def test_context_and_sources(spark):
    rows = spark.createDataFrame([(0, "b", 1, "B"), (0, "a", 2, "A"), (0, "b", 3, "B")], "query_id long, key string, rank int, t string")
    texts = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, text string")
    assert retrieval.context(rows, texts).first().context == "B\n\n---\n\nA"
    found = spark.createDataFrame([(0, 1, "a.py", None), (0, 2, "a.py", "f"), (0, 3, "b.py", "g")], "query_id long, rank int, source string, symbol_name string")
    got = [(r.source, r.language, r.symbol_name, r.total_chunks) for r in retrieval.source_summary(found).orderBy("rank").collect()]
    assert got == [("a.py", "unknown", "", 1), ("b.py", "unknown", "g", 1)]


def test_metrics(spark):
    r = spark.createDataFrame([(0, k, i) for i, k in enumerate("axyz", 1)] + [(1, k, i) for i, k in enumerate("xya", 1)], "query_id long, key string, rank int")
    truth = spark.createDataFrame([(0, "a"), (1, "a"), (1, "q"), (2, "a")], "query_id long, key string")
    q = spark.createDataFrame([(0,), (1,), (2,)], "query_id long")
    got = {x.query_id: (x.precision_at_k, x.recall_at_k, x.reciprocal_rank, x.hit) for x in evaluate.per_query(r, truth, 2, q).collect()}
    assert got == {0: (0.5, 1.0, 1.0, True), 1: (0.0, 0.0, pytest.approx(1 / 3), False), 2: (0.0, 0.0, 0.0, False)}
    row = evaluate.aggregate(evaluate.per_query(r, truth, 2, q)).first()
    assert (row.precision_at_k, row.recall_at_k, row.mrr, row.hit_rate, row.n) == (0.1667, 0.3333, 0.4444, 0.3333, 3)
    zero = evaluate.aggregate(evaluate.per_query(r.limit(0), truth.limit(0), 2)).first()
    assert (zero.mrr, zero.n) == (0.0, 0)


def test_judgements_and_runs(spark):
    rows = spark.createDataFrame([("correct", 1.0), ("partial", 0.5), ("incorrect", 0.0), ("correct", 1.0)], "verdict string, score double")
    r = evaluate.aggregate_judgements(rows).first()
    assert (r.score, r.correct, r.partial, r.incorrect, r.error, r.n) == (0.625, 2, 1, 1, 0, 4)
    assert evaluate.aggregate_judgements(rows.limit(0)).first().score == 0.0
    a = spark.createDataFrame([("r", "hit_rate", 0.9), ("r", "mrr", 0.7), ("r", "new", 1.0)], "section string, metric string, value double")
    b = spark.createDataFrame([("r", "hit_rate", 0.8), ("r", "mrr", 0.7), ("s", "mrr", 0.7)], "section string, metric string, value double")
    assert {x.metric: x.delta for x in evaluate.diff(a, b).collect()} == {"hit_rate": 0.1, "mrr": 0.0}
    runs = spark.createDataFrame([(1, "v", 0.1), (2, "h", 0.2), (3, "v", 0.3)], "line int, mode string, mrr double")
    assert {x.line: x.previous_mrr for x in evaluate.previous(runs, ["mode"], "line", ["mrr"]).collect()} == {1: None, 2: None, 3: 0.1}


def test_vector_search_holds_a_bounded_matrix(spark, monkeypatch):
    """Whatever part of the queries is multiplied at a time, the result is the same."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "key long, embedding array<float>").coalesce(1)
    q = rows.where("key < 25").withColumnRenamed("key", "query_id")
    want = sorted(vector.knn(q, rows, 5).collect())
    monkeypatch.setattr(vector, "CELLS", 200)
    assert sorted(vector.knn(q, rows, 5).collect()) == want and len(want) == 125


def test_reads_without_an_index(spark, tmp_path, monkeypatch):
    """Documents count as their index does, by few queries and by many, and no index is built for that."""
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "lone"), (902, "lone pair")], "key long, text string")
    corpus = zipf(spark, 400, 5).union(odd)
    monkeypatch.setattr(keyword, "BLOCK", 8)
    monkeypatch.setattr(keyword, "FIRST", 12)
    keyword.write(keyword.build(corpus), str(tmp_path))
    kept = keyword.read(spark, str(tmp_path))
    monkeypatch.setattr(keyword, "write", None)
    q = corpus.where("key % 20 = 0 OR key > 900").union(spark.createDataFrame([(903, "absent"), (904, "w300 w399")], "key long, text string")).withColumnRenamed("key", "query_id")
    few = sorted(keyword.reads(q, kept, 5).collect())
    assert len(few) == 22 and any(r.blocks_scored < r.blocks for r in few) and sorted(keyword.reads(q, keyword.index(corpus), 5).collect()) == few
    many = [(r.query_id, r.blocks, r.blocks, r.postings, r.postings) for r in few]
    texts, place = corpus.select("key", "text", keyword._place(corpus.count())).collect(), {}
    for r in texts:
        place.setdefault(r.block, []).append(set((r.text or "").split()))
    for query, blocks, _, postings, _ in many:
        words = {w for r in q.where(F.col("query_id") == query).collect() for w in (r.text or "").split()}
        assert (blocks, postings) == (sum(any(words & d for d in b) for b in place.values()), sum(len(words & d) for b in place.values() for d in b))
    monkeypatch.setattr(keyword, "JOINED", 0)
    for size, asked_tokens in ((100_000, 2_000_000), (6, 100)):
        monkeypatch.setattr(keyword_batch, "COUNTED", size)
        monkeypatch.setattr(keyword_batch, "ASKED", asked_tokens)
        for found in (kept, keyword.index(corpus)):
            assert [tuple(r) for r in sorted(keyword.reads(q, found, 5).collect())] == many
    assert keyword.reads(q.limit(0), keyword.index(corpus), 5).count() == 0
    assert keyword.reads(q, keyword.index(corpus.limit(0)), 5).count() == 0


def test_vector_search_memory_does_not_grow_with_the_queries(spark, monkeypatch):
    """A task's arrays take the same memory for 400 queries and for 4,000."""
    rng = np.random.default_rng(4)
    vectors = pa.array(rng.normal(size=(8000, 4)).tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), vectors], names=["key", "embedding"])
    rows, tasks = spark.createDataFrame(pa.Table.from_batches([batch])), []
    through = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, *a, **b: tasks.append(run) or through(self, run, *a, **b))
    peaks = []
    for n in (400, 4000):
        vector.knn(rows.where(F.col("key") < n).withColumnRenamed("key", "query_id"), rows, 5)
        tracemalloc.start()
        assert sum(b.num_rows for b in tasks[-1](iter([batch]))) == 5 * n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] < 60e6


def test_blocks_of_queries_share_a_pass(spark, monkeypatch):
    """Documents are read once for the statistics and once for several blocks of queries; copies tie by their key."""
    corpus = zipf(spark, 300, 6).union(spark.createDataFrame([(k, "w1 w2 w2 w9") for k in range(1000, 1060)], "key long, text string")).coalesce(1)
    q = corpus.where("key % 15 = 0").withColumnRenamed("key", "query_id")
    want = sorted(keyword.search(q, keyword.index(corpus), 3).collect())
    monkeypatch.setattr(keyword, "JOINED", 0)
    for name, value in (("QUERIES", 8), ("CELLS", 100), ("MATCHES", 20), ("TOKENS", 200)):
        monkeypatch.setattr(keyword_batch, name, value)
    passes = []
    through = type(corpus).mapInArrow
    monkeypatch.setattr(type(corpus), "mapInArrow", lambda self, run, *a, **b: passes.append(run) or through(self, run, *a, **b))
    assert sorted(keyword.search(q, keyword.index(corpus), 3).collect()) == want and len(want) == 72
    assert q.count() == 24 and len(passes) == 2
