import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera import config, schemas
from tessera.operators import chunking, conversation, embed, summaries, sync, telemetry
from tessera.sources import files, gitignore, logs
from tessera.sources.catalog import Catalog


def archive(entries, mode=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", mode) as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return out.getvalue()


# -- ignore files


@pytest.mark.parametrize(
    "patterns,path,folder,want",
    [
        ("build/", "build/x.py", False, True), ("build/", "build", False, False), ("build/", "a/build", True, True), ("*.log", "a/b.log", False, True), ("/coverage", "coverage", True, True),
        ("/coverage", "a/coverage", True, False), ("*.pyc\n!important.pyc", "important.pyc", False, False), ("*.pyc\n!important.pyc", "x.pyc", False, True), ("logs/\n!logs/keep.txt", "logs/keep.txt", False, True),
        ("a/**/z", "a/z", False, True), ("a/**/z", "a/b/c/z", False, True), ("**/foo", "x/foo", False, True), ("foo/**", "foo/a/b", False, True), ("# note\n\n", "a", False, False),
        ("data?.csv", "data1.csv", False, True), ("[ab].txt", "a.txt", False, True), ("[!ab].txt", "a.txt", False, False), ("\\#x", "#x", False, True), ("doc/*.txt", "doc/a/b.txt", False, False),
    ],
)
def test_ignore_rules(patterns, path, folder, want):
    assert gitignore.Ignore(gitignore.parse(patterns.splitlines())).ignored(path, folder) is want


def test_root_ignore_file():
    assert gitignore.find_root([".gitignore", "a.py"]) == ".gitignore"
    assert gitignore.find_root(["p/.gitignore", "p/a.py"]) == "p/.gitignore"
    assert gitignore.find_root(["p/.gitignore", "q/a.py"]) is None and gitignore.from_text("") is None


# -- files and archives


def test_directory(spark, tmp_path):
    tree = {"src/a.py": "x = 1", "src/b.png": "no", "node_modules/c.js": "no", "blank.py": " \n", "out/gen.py": "no", ".gitignore": "out/\n", "über+1.md": "ü", "latin.txt": None, "src/__init__.py": "i", "_priv/d.py": "d"}
    for name, content in tree.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes("é".encode("latin-1") * 3 if content is None else content.encode())
    rows = {r.path: r for r in files.from_directory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/a.py", "über+1.md", "latin.txt", "src/__init__.py", "_priv/d.py"} and rows["latin.txt"].content == "ééé"
    assert (rows["src/a.py"].extension, rows["src/a.py"].size_kb) == (".py", 0.0)
    assert "out/gen.py" in {r.path for r in files.from_directory(spark, str(tmp_path), respect_gitignore=False).collect()}
    assert {r.path for r in files.from_directory(spark, str(tmp_path), max_bytes=3).collect()} == {"über+1.md", "latin.txt", "src/__init__.py", "_priv/d.py"}


def test_skipped_and_ignored_folders_are_never_listed(spark, tmp_path):
    for name in ("a/b/x.py", "node_modules/m/y.py", "a/build/z.py", "gen/deep/w.py", ".git/c.py", "_p/__init__.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    root = spark._jvm.org.apache.hadoop.fs.Path(str(tmp_path))
    fs, seen = root.getFileSystem(spark._jsc.hadoopConfiguration()), []

    def listing(path):
        seen.append(path.getName())
        return fs.listStatus(path)

    plain, named = files._walk(listing, root, gitignore.from_text("gen/\n"))
    assert sorted(seen) == sorted([tmp_path.name, "a", "b", "_p"]) and [p.rsplit("/", 1)[1] for p in plain] == ["x.py"] and [s.getPath().getName() for s in named] == ["__init__.py"]


def test_encodings_of_files(spark, tmp_path):
    (tmp_path / "ru.txt").write_bytes("Функция возвращает имя пользователя, если запись найдена".encode("cp1251"))
    (tmp_path / "ja.md").write_bytes("この関数はユーザーの名前を返します。見つからないときは".encode("cp932"))
    (tmp_path / "wide.py").write_bytes("x = 'é'".encode("utf-16"))
    rows = {r.path: r.content for r in files.from_directory(spark, str(tmp_path)).collect()}
    assert rows == {"ru.txt": "Функция возвращает имя пользователя, если запись найдена", "ja.md": "この関数はユーザーの名前を返します。見つからないときは", "wide.py": "x = 'é'"}


def test_archives(spark, tmp_path):
    (tmp_path / "p.zip").write_bytes(archive({"proj/a.py": "a", "proj/.gitignore": "*.md\n", "proj/b.md": "no", "proj/dist/c.py": "no", "up.zip/d.py": "d"}))
    assert {r.path for r in files.from_zip(spark, str(tmp_path / "p.zip")).collect()} >= {"proj/a.py", "d.py"}
    (tmp_path / "q.zip").write_bytes(archive({"proj/a.py": "a", "proj/.gitignore": "*.md\n", "proj/b.md": "no"}))
    assert {r.path for r in files.from_zip(spark, str(tmp_path / "q.zip")).collect()} == {"proj/a.py"}


@pytest.mark.parametrize(
    "entries,settings",
    [({"../../evil.py": "x"}, {}), ({"/abs.py": "x"}, {}), ({f"f{i}.py": "x" for i in range(50)}, {"max_zip_entries": 10}), ({"big.py": b"0" * (2 << 20)}, {"max_zip_mb": 1}), ({"bomb.py": b"0" * (9 << 20)}, {"max_zip_ratio": 100})],
)
def test_unsafe_archives(entries, settings):
    with pytest.raises(files.UnsafeArchive):
        list(files.unpack(archive(entries), config.Settings(**settings)))


def test_uploads(spark):
    ups = [("a.py", b"x"), ("b.exe", b"x"), ("c\\d.md", "é".encode()), ("p.zip", archive({"z.py": "z", "build/y.py": "no"})), ("e.py", b"  ")]
    assert {r.path for r in files.from_uploads(spark, ups).collect()} == {"a.py", "c/d.md", "z.py"}
    with pytest.raises(files.UnsafeArchive):
        files.from_uploads(spark, [("a.py", b"x" * (2 << 20))], config.Settings(max_upload_mb=1))


def test_summaries(spark):
    rows = spark.createDataFrame([("a.py", ".py", 1.0), ("b.py", ".py", 2.0), ("c.js", ".js", 0.5), ("d", "", 0.0)], "path string, extension string, size_kb double")
    assert tuple(summaries.file_summary(rows).first()) == (4, 3.5)
    assert {r.extension: r.files for r in summaries.files_by_extension(rows).collect()} == {".py": 2, ".js": 1, "unknown": 1}
    assert [(r.n, r.place, r.path) for r in summaries.paths_by_language(rows).where("language = 'Python'").orderBy("place").collect()] == [(2, 1, "a.py"), (2, 2, "b.py")]
    assert summaries.file_summary(rows.limit(0)).first().total_kb == 0.0


# -- logs


def test_log_lines(spark):
    lines = spark.createDataFrame([('{"collection": "p", "hit_count": 2}',), ("not valid json",), ("",), ("  ",), (None,), ('{"timestamp": "bad"}',)], "value string")
    rows = logs.parse(lines, schemas.QUERY_LOG).collect()
    assert [(r.collection, r.hit_count) for r in rows] == [("p", 2), (None, None)]


def test_record_and_read(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logs.query_log(spark, path).count() == 0
    telemetry.record(spark, path, collection="p", retrieval_mode="vector", hit_count=3, total_latency_ms=5.0, error=False)
    telemetry.record(spark, path, collection="q", retrieval_mode="mmr", error=True)
    rows = logs.query_log(spark, path)
    assert rows.count() == 2 and set(rows.columns) == {x.split()[0] for x in schemas.QUERY_LOG.split(", ")}
    with pytest.raises(ValueError):
        telemetry.record(spark, path, question="secret")


def test_metric_denominators(spark):
    rows = [("2026-06-01T00:00:00+00:00", "p", "vector", 2, 10.0, 100.0, 250.0, 40, 4, False), ("2026-06-02T00:00:00+00:00", "p", "hybrid_rerank", 0, 30.0, None, 30.0, None, None, True), ("bad", "q", None, 0, 20.0, 300.0, 340.0, 60, 6, False)]
    df = spark.createDataFrame(rows, "timestamp string, collection string, retrieval_mode string, hit_count long, retrieval_latency_ms double, generation_latency_ms double, total_latency_ms double, prompt_tokens_estimate long, completion_tokens_estimate long, error boolean")
    got = {r["mode"]: r for r in telemetry.summary(df).collect()}
    assert set(got) == {None, "vector", "hybrid_rerank", "unknown"}
    o = got[None]
    assert (o.total_queries, o.error_count, o.hit_rate, o.avg_generation_latency_ms, o.avg_total_latency_ms, o.p50_total_latency_ms, o.p95_total_latency_ms, o.avg_prompt_tokens) == (3, 1, 0.5, 200.0, 206.67, 250.0, 340.0, 50.0)
    assert telemetry.since(df, "2026-06-01T12:00:00").count() == 1 and telemetry.since(df, collection="p").count() == 2
    none = telemetry.summary(df.limit(0)).collect()
    assert len(none) == 1 and none[0].total_queries == 0 and none[0].p95_total_latency_ms == 0.0


# -- sync and catalog


def test_diff_and_replace(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2x"), ("c", "3"), ("c", "9")], "path string, hash string")
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("z", "0")], "path string, stored string")
    assert {r.path: r.status for r in sync.diff(now, stored).collect()} == {"a": "unchanged", "b": "updated", "c": "new"}
    full = sync.diff(now, stored, full_sync=True)
    assert {r.path: r.status for r in full.collect()}["z"] == "deleted"
    assert tuple(sync.stats(full).first()) == (1, 1, 1, 1)
    chunks = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("z", 0)], "source string, chunk_index int")
    added = spark.createDataFrame([("b", 0), ("c", 0)], "source string, chunk_index int")
    assert sorted(map(tuple, sync.replace(chunks, full, added).collect())) == [("a", 0), ("b", 0), ("c", 0)]
    assert sync.delete_sources(chunks, ["b"]).count() == 2 and sync.delete_sources(chunks, []).count() == 4


def test_embedding_once(spark):
    rows = spark.createDataFrame([("a.py", 0, "h1", "x one"), ("b.py", 0, "h1", "y one"), ("c.py", 0, "h2", "z"), ("d.py", 0, "", "z"), ("e.py", 0, None, "z")], "source string, chunk_index int, chunk_content_hash string, page_content string")
    seen = spark.sparkContext.accumulator(0)

    def embedder(texts):
        seen.add(len(texts))
        return [[float(len(t)), float(ord(t[0]))] for t in texts]

    got = {r.source: list(r.embedding) for r in embed.embed_distinct(rows, embedder, 2).collect()}
    assert seen.value == 4 and got["a.py"] == got["b.py"] == [5.0, float(ord("x"))] and len(got) == 5

    def broken(texts):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        embed.embed_distinct(rows, broken).collect()


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "w"))
    assert c.list() == [] and c.read("none").count() == 0 and not c.drop("none")
    assert c.create("p").count() == 0 and c.exists("p")
    rows = chunking.ingest(spark.createDataFrame([("a.py", "def f():\n    return 1\n", 0.1), ("b.md", "text", 0.1)], "path string, content string, size_kb double"))
    rows = embed.embed_distinct(rows, embed.hashing_embedder(4))
    for _ in range(3):
        c.replace("p", rows)
    c.replace("eval-x", rows)
    assert c.list() == [{"name": "p", "chunk_count": 2}]
    assert [r[0] for r in c.sources("p").collect()] == ["a.py", "b.md"] and [r[0] for r in c.symbols("p").collect()] == ["f"]
    assert {r.path for r in c.hashes("p").collect()} == {"a.py", "b.md"}
    c.delete_sources("p", ["a.py"])
    assert c.read("p").count() == 1 and c.drop("p") and not c.exists("p")


# -- conversations


def test_turns(spark):
    turns = [{"role": r, "content": c} for i in range(5) for r, c in (("user", f"q{i}"), ("assistant", f"a{i}" if i != 4 else " "))]
    df = spark.createDataFrame([(1, n, t["role"], t["content"]) for n, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for most in (2, 0):
        assert conversation.recent_turns(df, most).first().history == conversation.format_history(turns, most)
    assert conversation.format_history(turns, 2) == "User: q3\nAssistant: a3\nUser: q4"
    assert conversation.format_history([{"role": "user", "content": "x" * 1000}]) == "User: " + "x" * 500 + "..."


def test_rewrite_and_expand():
    hist = [{"role": "user", "content": "what is f?"}]
    assert conversation.standalone("and g?", None, lambda p: 1 / 0) == "and g?"
    assert conversation.standalone("and g?", hist, lambda p: 1 / 0) == "and g?"
    assert conversation.standalone("and g?", hist, lambda p: ' "what is g?" ' if "what is f?" in p else "") == "what is g?"
    assert conversation.standalone("and g?", hist, lambda p: " ") == "and g?"
    assert conversation.expand("Q", lambda p: "1. a\n2. q\n3. A\n4. b", 4) == ["a", "b"]
    assert conversation.expand("Q", lambda p: "1. a\n2. b", 0) == [] and conversation.expand("Q", lambda p: 1 / 0) == []


def test_json_round_trip_of_runs(spark, tmp_path):
    from tessera.operators import evaluate

    path = str(tmp_path / "runs")
    for v in (0.5, 0.75):
        evaluate.record_run(spark, path, 6, 3, {"vector": {"retrieval": {"mrr": v}}}, config.Settings())
    runs = logs.eval_runs(spark, path)
    assert [r.value for r in evaluate.history(runs, 1).collect()] == [0.75] and json.loads("1") == 1
    assert runs.first().config["top_k"] == "6" and runs.where(F.col("n") == 3).count() == 2
