"""Collections in segments against what is in them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.engine import Engine
from tessera.operators import keyword
from tessera.sources.catalog import CHUNKS, Catalog, Conflict

WORDS = ["login", "mail", "user", "send", "parse", "config", "render", "the", "a", "of"]


def chunks(spark, files):
    """One chunk a line of each file (source to text)."""
    rows = [(s, i, line, [float(len(line)), 1.0]) for s, t in files.items() for i, line in enumerate(t.split("\n"))]
    df = spark.createDataFrame(rows, "source string, chunk_index int, page_content string, embedding array<float>")
    have = {"source", "chunk_index", "page_content", "embedding"}
    return df.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in CHUNKS.split(", ")) if c not in have))


def sources(spark, names):
    return spark.createDataFrame([(n,) for n in names], "source string")


def told(catalog, name="p"):
    out = {}
    for r in sorted(catalog.read(name).collect(), key=lambda r: (r.source, r.chunk_index)):
        out.setdefault(r.source, []).append(r.page_content)
    return {s: "\n".join(x) for s, x in out.items()}


def size(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}


@pytest.mark.parametrize("seed", [0])
def test_random_syncs_equal_a_full_build(spark, tmp_path, seed):
    rng, files = random.Random(seed), {}
    c = Catalog(spark, str(tmp_path / "w"))
    q = spark.createDataFrame([(0, "login user the"), (1, "mail of a of"), (2, "absent config")], "query_id long, text string")
    text = lambda: "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 4)))
    for step in range(8):
        changed = {f"f{i}.py": text() for i in rng.sample(range(12), rng.choice([1, 2, 6]) if step else 9)}
        deleted = rng.sample(sorted(files), min(len(files), rng.choice([0, 0, 1, 3])))
        deleted = [d for d in deleted if d not in changed]
        assert c.add("p", chunks(spark, changed), sources(spark, [*changed, *deleted])) == sum(len(t.split("\n")) for t in changed.values())
        files = {s: t for s, t in (files | changed).items() if s not in deleted}
        assert told(c) == files and c.count("p") == sum(len(t.split("\n")) for t in files.values())
        index, rows = c.words("p"), c.keyed("p").withColumn("text", F.col("page_content"))
        if step in (3, 7):
            assert sorted(keyword.search(q, index, 5).collect()) == sorted(keyword.search(q, keyword.index(rows), 5).collect())
            assert sorted(keyword.document_frequency(index).collect()) == sorted(keyword.document_frequency(keyword.index(rows)).collect())
            part = rows.where("source < 'f5'")
            assert sorted(keyword.search(q, index.only(part.select("key")), 5).collect()) == sorted(keyword.search(q, keyword.index(part), 5).collect())
    sizes = [s["rows"] for s in c._current("p")[1]]
    assert all(sizes[i] > 2 * sum(sizes[i + 1 :]) for i in range(len(sizes) - 1))
    c.delete_sources("p", sorted(files))
    assert told(c) == {} and c.count("p") == 0 and keyword.search(q, c.words("p"), 5).collect() == []


def test_a_small_sync_writes_little(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=8))
    c = Catalog(spark, str(tmp_path / "w"))
    c.add("p", chunks(spark, {f"f{i}.py": "\n".join(" ".join(word() for _ in range(40)) for _ in range(20)) for i in range(150)}), sources(spark, []))
    before = size(tmp_path / "w")
    c.add("p", chunks(spark, {"f3.py": "one new line"}), sources(spark, ["f3.py"]))
    after = size(tmp_path / "w")
    assert set(before) <= set(after)
    new = sum(n for f, n in after.items() if f not in before)
    assert sum(before.values()) > 10 * new and told(c)["f3.py"] == "one new line" and c.count("p") == 149 * 20 + 1


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = (Catalog(spark, str(tmp_path / "w")) for _ in range(2))
    a.add("p", chunks(spark, {"x.py": "old x", "y.py": "old y"}), sources(spark, ["x.py", "y.py"]))
    commit = a._commit

    def late(name, number, segments):
        """The other writer comes between."""
        a._commit = commit
        b.add("p", chunks(spark, {"y.py": "new y", "z.py": "new z"}), sources(spark, ["y.py", "z.py"]))
        return commit(name, number, segments)

    a._commit = late
    a.add("p", chunks(spark, {"x.py": "new x", "z.py": "last z"}), sources(spark, ["x.py", "z.py"]))
    assert told(a) == told(b) == {"x.py": "new x", "y.py": "new y", "z.py": "last z"}
    a._commit = lambda *_: False
    with pytest.raises(Conflict):
        a.add("p", chunks(spark, {"x.py": "never"}), sources(spark, ["x.py"]), tries=2)
    assert told(b)["x.py"] == "new x"


def test_a_broken_manifest_is_passed_over(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "w"))
    c.add("p", chunks(spark, {"x.py": "x"}), sources(spark, ["x.py"]))
    (tmp_path / "w" / "p" / "manifest-00000001").write_text('{"segm')
    assert told(c) == {"x.py": "x"}
    c.add("p", chunks(spark, {"y.py": "y"}), sources(spark, ["y.py"]))
    assert told(c) == {"x.py": "x", "y.py": "y"}


def test_old_versions_go(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "w"))
    for i in range(4):
        c.add("p", chunks(spark, {"x.py": f"text {i}"}), sources(spark, ["x.py"]))
    left = [n for n in os.listdir(tmp_path / "w" / "p") if not n.startswith(".")]
    assert len([n for n in left if n.startswith("manifest")]) == 3 and len([n for n in left if n.startswith("segment")]) <= 5


def test_the_engine_searches_by_the_vector_index(spark, tmp_path):
    s = config.Settings(warehouse=str(tmp_path / "w"), query_log=str(tmp_path / "q"), eval_log=str(tmp_path / "e"), top_k=3, vector_index=True)
    engine = Engine(spark, s)
    files = [(f"f{i}.md", f"{WORDS[i % 7]} number{i} {WORDS[i % 5]}".encode()) for i in range(30)]
    engine.index_uploads("app", files)
    engine.index_uploads("app", [("f3.md", b"changed words only"), ("new.md", b"quite new")])
    exact = Engine(spark, config.Settings(**{**vars(s), "vector_index": False}))
    assert engine.catalog.vector_index("app").rows.count() == 31
    for mode in ("vector", "hybrid"):
        got = [(r.source, r.score) for r in engine.retrieve("app", "changed words", mode).orderBy("rank").collect()]
        assert got[0][0] == "f3.md" and len(got) == 3
        exact.catalog.vector_index = lambda name: None
        assert [(r.source, r.score) for r in exact.retrieve("app", "changed words", mode).orderBy("rank").collect()] == got
    assert {r.source for r in engine.retrieve("app", "login", "vector", source="f7.md").collect()} == {"f7.md"}
