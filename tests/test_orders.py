"""Running totals, line numbers and percentiles over data that no single task holds."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, prefix, ranks
from tessera.plans import queries
from tessera.sources import logs


def test_running_totals_cross_partitions(spark):
    rng = random.Random(0)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5, -2]), "x") for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, id long, n long, _range string").withColumnRenamed("_range", "other")
    got = {(r.source, r.id): (r.total, r.twice, r.at) for r in prefix.running(df, ["source"], ["id"], {"total": F.col("n"), "twice": 2 * F.col("n")}, "at").collect()}
    want, sums, at = {}, {}, {}
    for s, i, n, _ in sorted(rows, key=lambda r: r[1]):
        sums[s], at[s] = sums.get(s, 0) + (n or 0), at.get(s, 0) + 1
        want[s, i] = (sums[s], 2 * sums[s], at[s])
    assert got == want
    whole = prefix.running(df, [], ["id"], place="at").collect()
    assert sorted((r.id, r.at) for r in whole) == [(i, i + 1) for i in range(600)] and whole[0].asDict().keys() == {"source", "id", "n", "other", "at"}
    assert prefix.running(df.limit(0), ["source"], ["id"], place="at").collect() == []


@pytest.mark.parametrize("name", ["running_size_cap", "batch_assign"])
def test_a_single_source_is_dealt_out(spark, small, tmp_path, name):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("source", F.lit("one"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    # else the few rows of the test would be put together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = queries.QUERIES[name](spark, str(tmp_path))
        parts = df.rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 200 and max(parts) <= 120


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for f, n in (("a.txt", 3000), ("b.txt", 1)):
        (folder / f).write_text("".join(f"line {i} of {f}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = logs.numbered(spark, str(folder))
        rows = df.collect()
        assert df.select("value").rdd.getNumPartitions() > 2 or len(rows) == 3001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3001 and all(r.value.startswith(f"line {r.line} of ") and r.file.endswith(r.value.split()[-1]) for r in rows)


def test_the_last_runs_are_the_last_lines(spark, tmp_path):
    run = lambda stamp, v: json.dumps({"timestamp": stamp, "k": 6, "n": 1, "config": {}, "results": {"vector": {"retrieval": {"mrr": v}}}})
    path = tmp_path / "runs.jsonl"
    path.write_text("\n".join([run("2026-01-03", 0.1), "broken", run("2026-01-01", 0.2), run("2026-01-01", 0.3), ""]))
    runs = logs.eval_runs(spark, str(path))
    assert [r.place.line for r in runs.orderBy("place").collect()] == [1, 3, 4]
    assert sorted(r.value for r in evaluate.history(runs, 2).collect()) == [0.2, 0.3]


def brute(values, p):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    return values[min(int(len(values) * p), len(values) - 1)]


@pytest.mark.parametrize("few", [5, 100_000])
def test_percentiles_by_narrowing(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "CUTS", 512 if few == 5 else 4096)
    rng = random.Random(1)
    groups = {
        "plain": [rng.random() for _ in range(900)],
        "wide": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(500)],
        "same": [0.5] * 400,
        "ends": [float("-inf"), float("inf"), 1.7e308, -1.7e308, 0.0, -0.0, 5e-324, float("nan")] * 3,
        "near": [1.0 + i * 2.0**-52 for i in range(300)],
        None: [7.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None)]
    rng.shuffle(rows)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: [r[n] for n in shares] for r in ranks.nearest_ranks(df, "v", shares, ("g",)).collect()}
    want = {g: [brute(vs, p) for p in shares.values()] for g, vs in groups.items()}
    assert repr(sorted(got.items(), key=repr)).replace("-0.0", "0.0") == repr(sorted(want.items(), key=repr)).replace("-0.0", "0.0")
    one = ranks.nearest_ranks(df.where("g <> 'ends'"), "v", {"p50": 0.5}).first().p50
    assert one == brute([v for g, vs in groups.items() if g not in ("ends", None) for v in vs], 0.5)
    assert [tuple(r) for r in ranks.nearest_ranks(df.where("g = 'none'"), "v", {"p50": 0.5}).collect()] == [(None,)]


def test_no_window_of_percentiles_is_without_keys(spark, small):
    for name in ("metrics_overall_and_by_mode", "nearest_rank_percentiles"):
        df = queries.QUERIES[name](spark, small)
        df.collect()
        lines = [x.strip(" +-:*") for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
        for at, x in enumerate(lines):
            if x.split(") ")[-1].startswith("Window"):
                assert not any(y.startswith("Exchange SinglePartition") for y in lines[at : at + 4])


def test_evaluation_by_label_makes_no_pairs(spark, small):
    got = queries.QUERIES["eval_per_query"](spark, small)
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "label")
    found = queries.retrieval.retrieve(queries._vector_queries(spark, small), spark.read.parquet(f"{small}/embeddings.parquet"), "vector", key="vec_id", unit=True)
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    want = evaluate.per_query(found, asked.join(rows, "label").select("query_id", "vec_id"), 6, asked, "vec_id")
    assert sorted(got.collect()) == sorted(want.collect())
