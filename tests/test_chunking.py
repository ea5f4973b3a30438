import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera import config
from tessera.operators import chunking

PY = '''import os
X = 1

@wraps(f)
def deco(a):
    return "é" + a

class A(Base):
    """Doc."""
    y = 2

    def first(self):
        return 1

    async def second(self):
        return "ü"

def last():
    pass
'''


def names(pieces):
    return [(p.symbol_name, p.symbol_type, p.parent_symbol) for p in pieces]


def test_python():
    got = chunking.by_definition(PY, "Python")
    assert names(got) == [("", "", ""), ("deco", "function", ""), ("A", "class", ""), ("first", "method", "A"), ("second", "method", "A"), ("last", "function", "")]
    assert got[1].text.startswith("@wraps(f)\ndef deco") and got[1].text.endswith('"é" + a')
    assert got[2].text.endswith("y = 2") and got[4].text == '# (method of A)\nasync def second(self):\n        return "ü"'
    assert chunking.by_definition("def broken(:", "Python") is None and chunking.by_definition("", "Python") is None
    assert names(chunking.by_definition("@d\nclass B:\n    def m(self): pass\n", "Python")) == [("B", "class", "")]


@pytest.mark.parametrize(
    "language,source,want",
    [
        ("JavaScript", 'import x from "y";\nfunction f(a) { return "}"; }\nclass K {\n  constructor() { this.a = 1; }\n  run(x) { if (x) { return 2; } }\n}\nconst z = () => { return 1; };\n', ["", "f", "K", "constructor", "run", "z"]),
        ("Go", "package main\n\nimport \"fmt\"\n\nfunc Add(a int) int {\n\treturn a // }\n}\n\nfunc (s *S) M() {\n}\n\ntype S struct {\n\ta int\n}\n", ["", "Add", "M", "S"]),
        ("C++", "#include <x>\n\nint add(int a) {\n  return a;\n}\n\nclass P {\n public:\n  int get() { return 1; }\n};\n", ["", "add", "P", "get"]),
        ("Rust", "use x;\n\nfn go() { }\n\nstruct T { a: i32 }\n\nimpl T {\n    pub fn m(&self) { }\n}\n\nenum E { A }\n\ntrait R { }\n", ["", "go", "T", "T", "m", "E", "R"]),
        ("Java", "package p;\n\npublic class Q {\n  private int a;\n  public Q() { a = 1; }\n  public int get(int x) throws E { return a; }\n}\n", ["", "Q", "Q", "get"]),
        ("C", "struct s { int a; };\n\nstatic int *f(void) {\n  return 0;\n}\n", ["s", "f"]),
        ("TypeScript", "interface I { a: string }\n\nclass C {\n  go(): void { }\n}\n", ["I", "C", "go"]),
    ],
)
def test_brace_languages(language, source, want):
    got = chunking.by_definition(source, language)
    assert [p.symbol_name for p in got] == want
    assert all("(method of" in p.text for p in got if p.parent_symbol)


def test_oversized_definitions_keep_their_symbols():
    body = "def f():\n" + "".join(f"    x{i} = {i}\n" for i in range(400))
    got = chunking.by_definition(body, "Python", 500)
    assert len(got) > 1 and {p.symbol_name for p in got} == {"f"} and all(len(p.text) <= 500 for p in got)


@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=100, deadline=None)
def test_split_pieces(text, size, overlap):
    got = chunking.split_text(text, config.DEFAULT_SEPARATORS, size, overlap)
    assert all(0 < len(p) <= size for p in got)
    squeeze = lambda t: "".join(t.split())
    if overlap == 0:
        assert squeeze("".join(got)) == squeeze(text)
    at = 0
    for p in got:
        assert p in text
        at = max(at, text.find(p))


def test_split_overlaps():
    text = " ".join(f"word{i}" for i in range(100))
    got = chunking.split_text(text, config.DEFAULT_SEPARATORS, 100, 30)
    assert all(b.split()[0] in a for a, b in zip(got, got[1:]))


def test_ingest(spark):
    rows = [("pkg/models.py", PY, 0.3), ("notes.md", "hello\n\nworld", 0.1), ("empty.md", " ", 0.0), ("vendor/a.py", "def s():\n    return 1\n", 0.1), ("vendor/b.py", "def s():\n    return 1\n", 0.1)]
    got = chunking.ingest(spark.createDataFrame(rows, "path string, content string, size_kb double")).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert set(by) == {r[0] for r in rows} - {"empty.md"}
    m = sorted(by["pkg/models.py"], key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in m] == list(range(6)) and {r.total_chunks for r in m} == {6} and {r.chunk_method for r in m} == {"ast"}
    assert m[0].role == "data models" and m[0].page_content.startswith("# File: pkg/models.py\n# Language: Python\n# Role: data models\n---\nimport os")
    assert m[0].content_hash == hashlib.sha256(PY.encode()).hexdigest()
    a, b = by["vendor/a.py"][0], by["vendor/b.py"][0]
    assert a.chunk_content_hash == b.chunk_content_hash and a.page_content != b.page_content
    assert by["notes.md"][0].chunk_method == "heuristic" and by["notes.md"][0].symbol_name == "" and by["notes.md"][0].role == ""


def test_files_are_cut_in_parts_of_bounded_bytes(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chunking, "BYTES", 50)
    batch = pa.record_batch({"content": pa.array(["a" * 30, None, "b" * 30, "", "c" * 200, "d"])})
    parts = list(chunking._parts(batch))
    assert [p.num_rows for p in parts] == [2, 2, 1, 1] and pa.Table.from_batches(parts).equals(pa.table(batch.to_pydict(), batch.schema))
    files = spark.createDataFrame([("a/x.txt", "one two", 0.1), ("a/y.py", "def f():\n    return 1\n", 0.1), ("z.txt", None, 0.0)], "path string, content string, size_kb double").coalesce(1)
    rows = {r.source: (r.chunk_index, r.total_chunks, r.symbol_name) for r in chunking.ingest(files).collect()}
    assert rows == {"a/x.txt": (0, 1, ""), "a/y.py": (0, 1, "f")}
