import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.operators.ranks import nearest_ranks


def one(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_extension_and_language(spark):
    cases = {"a/b.PY": (".py", "Python"), ".env": ("", "Unknown"), "x.tar.gz": (".gz", "Unknown"), "dir.py/file": ("", "Unknown"), "a.": ("", "Unknown"), "q.cc": (".cc", "C++"), "r.R": (".r", "R")}
    assert one(spark, cases, P.extension("x")) == [v[0] for v in cases.values()]
    assert one(spark, cases, P.language("x")) == [v[1] for v in cases.values()]


def test_context_and_icons(spark):
    rows = spark.createDataFrame([(p,) for p in ("a.py", "b.json", "c.md", "d.zzz")], "x string").select(P.language_context("x").alias("c"), P.icon("x").alias("i")).collect()
    assert [(r.c.language, r.c.fence, r.c.is_code, r.c.is_config, r.c.is_markup) for r in rows] == [("Python", "python", True, False, False), ("JSON", "json", False, True, False), ("Markdown", "markdown", False, False, True), ("Unknown", "", False, False, False)]
    assert [r.i for r in rows] == ["🐍", "📋", "📝", config.DEFAULT_ICON]


def test_roles_go_by_name_then_path(spark):
    cases = {"src/Main.py": "application entry point", "tests/api/x.py": "test file", "db/migrations/api.py": "database migration", "middleware/api.py": "middleware", "api/v.py": "API layer", "plain.py": None, "tests/utils.py": "utility/helper functions"}
    assert one(spark, cases, P.role("x")) == list(cases.values())


def test_readable(spark):
    cases = {"a/b.py": True, "a.lock": False, "node_modules/a.js": False, "a/build/x.py": False, "builder/x.py": True, "a.zzz": False, "a.PY": True}
    assert one(spark, cases, P.readable("x")) == list(cases.values())


def test_collection_names(spark):
    cases = {"My Project!!": "my-project", "--a--": "a-qa", "x" * 80: "x" * 63, "a/b\\c": "a-b-c", "é": "-qa", "abc": "abc"}
    assert one(spark, cases, P.collection_name("x")) == list(cases.values())


def test_posix_sizes_and_prefixes(spark):
    assert one(spark, ["up.zip\\a\\b.py", "a/up.zip/b", "x.py"], P.posix("x")) == ["a/b.py", "a/up.zip/b", "x.py"]
    assert one(spark, [(2048,), (1,)], P.size_kb("x"), "x long") == [2.0, 0.0]
    got = one(spark, ["a/b/c.py"], P.prefixes("x"))[0]
    assert [tuple(p) for p in got] == [(1, "a", "a", False), (2, "a/b", "b", False), (3, "a/b/c.py", "c.py", True)]


def tokens(text):
    out = []
    for t in re.findall(r"[a-z_][a-z0-9_]*|[0-9]+", text.lower()):
        out.append(t)
        if "_" in t:
            out += [p for p in t.split("_") if p]
    return out


def test_tokens(spark):
    cases = ["retrieve_documents(k=10)", "__init__ a__b _", "Straße été 12ab", "", "A a A"]
    assert one(spark, cases, T.tokens("x")) == [tokens(c) for c in cases]


@given(st.lists(st.text(alphabet="aB_1 é-", max_size=12), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None)
def test_tokens_of_any_text(spark, texts):
    assert one(spark, texts, T.tokens("x")) == [tokens(t) for t in texts]


def test_token_estimates_round_half_to_even(spark):
    assert one(spark, ["", "ab", "a" * 6, "a" * 10, "é" * 14], T.token_estimate("x")) == [1, 1, 2, 2, 4]


def test_headers(spark):
    rows = [("a.py", "Python", "data models"), ("b.py", "Python", None), ("c.py", "Python", "")]
    got = one(spark, rows, T.chunk_header("p", "l", "r"), "p string, l string, r string")
    assert got == ["# File: a.py\n# Language: Python\n# Role: data models\n---\n", "# File: b.py\n# Language: Python\n---\n", "# File: c.py\n# Language: Python\n---\n"]


def test_hash_blank_shortened(spark):
    assert one(spark, ["é"], T.content_hash("x")) == [hashlib.sha256("é".encode()).hexdigest()]
    assert one(spark, ["", " \n\t", "a", None], T.not_blank("x")) == [False, False, True, False]
    assert one(spark, ["x" * 1000, "y" * 500], T.shortened("x")) == ["x" * 500 + "...", "y" * 500]
    assert one(spark, ["user", "assistant", "system"], T.speaker("x")) == ["User", "Assistant", "Assistant"]
    assert one(spark, [' "quoted" ', '""', "plain"], T.bare("x")) == ["quoted", "", "plain"]


@pytest.mark.parametrize("text,n,want", [("1. a\n2. b", 5, ["a", "b"]), ("1) foo\n\n- bar\n* baz\n• qux", 3, ["foo", "bar", "baz"]), ("plain\nlines", 2, ["plain", "lines"]), ('1. "quoted"', 1, ["quoted"]), ("", 2, []), ("1. a", 0, [])])
def test_lists(spark, text, n, want):
    assert one(spark, [text], T.list_items("x", n)) == [want]


def test_keywords(spark):
    rows = [("Uses SHA256 only.", ["sha256", "hash", "file"]), ("x", []), (None, ["a"])]
    got = one(spark, rows, T.keyword_coverage("a", "k"), "a string, k array<string>")
    assert got == [pytest.approx(1 / 3), 0.0, 0.0]
    assert one(spark, rows, T.keyword_hit("a", "k"), "a string, k array<string>") == [False] * 3


def test_judge_responses(spark):
    cases = {
        '{"verdict": "correct", "reasoning": "ok"}': ("correct", "ok", 1.0),
        'Sure!\n```json\n{"verdict": " Partial "}\n```': ("partial", "", 0.5),
        '{"verdict": "INCORRECT"}': ("incorrect", "", 0.0),
        '{"verdict": "maybe"}': ("error", "", 0.0),
        "no object": ("error", "", 0.0),
        "{broken": ("error", "", 0.0),
        "": ("error", "", 0.0),
    }
    assert [tuple(x) for x in one(spark, cases, T.judge_response("x"))] == list(cases.values())


@given(st.lists(st.floats(0, 1000).map(lambda x: round(x, 3)), max_size=30), st.sampled_from([0.0, 0.5, 0.95, 1.0]))
@settings(max_examples=8, deadline=None)
def test_nearest_rank(spark, values, p):
    got = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = nearest_ranks(got, "x", {"p": p}).first().p
    assert got == (sorted(values)[min(int(len(values) * p), len(values) - 1)] if values else None)


def test_cosine(spark):
    got = one(spark, [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], T.cosine("a", "b"), "a array<float>, b array<float>")
    assert got == [pytest.approx(0.5**0.5), 0.0]


def test_settings(tmp_path):
    s = config.Settings.from_env({"TOP_K": "3", "ENABLE_QUERY_EXPANSION": "TRUE", "MMR_LAMBDA": "0.2", "QUERY_LOG": "/x"}, root="/base")
    assert (s.top_k, s.enable_query_expansion, s.mmr_lambda, s.query_log, s.warehouse) == (3, True, 0.2, "/x", "/base/warehouse")
    with pytest.raises(ValueError, match="NEEDED"):
        config.Settings.from_env({}, required=("needed",))
    with pytest.raises(ValueError):
        config.Settings(mmr_lambda=2)
    assert F.lit(1) is not None


def test_rounding_is_exact_and_half_even(spark):
    import random
    import struct

    rng = random.Random(0)
    cases = [2.675, 1.005, 0.125, 0.375, -0.125, -2.675, 0.5, 1.5, 2.5, 1e15, 1e300, -0.0, 5e-324, 0.015, 1.115, 4503599627370495.5]
    cases += [rng.uniform(-100, 100) for _ in range(20_000)] + [rng.randint(-(10**6), 10**6) / 1000 for _ in range(20_000)] + [(2 * rng.randint(-(10**5), 10**5) + 1) / 2**k for k in range(1, 12) for _ in range(500)]
    cases += [x for x in (struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(20_000)) if abs(x) < 1e11]
    df = spark.createDataFrame([(float(x),) for x in cases], "x double").select("x", *(T.rounded("x", d).alias(f"r{d}") for d in (0, 2, 4)))
    for r in df.collect():
        for d in (0, 2, 4):
            assert r[f"r{d}"] == round(r.x, d), (r.x, d)
    assert one(spark, [(None,), (float("inf"),), (2.675,)], T.rounded("x", 2), "x double") == [None, float("inf"), 2.67]
    assert one(spark, [(128,), (384,)], P.size_kb("x"), "x long") == [0.12, 0.38]
