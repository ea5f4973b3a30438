"""Operators on single texts and their odd inputs: licenses, quality, decontamination, language, scoring, repeats."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, licenses, lm, mixing, quality, simhash, substring_dedup
from tessera.llm._exchange import group_size, packed
from tessera.llm._hashing import Words, window_hashes, window_starts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, labels string, n_words string, `row` string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns named like results."""
    rows = [
        (1, None, None, None, "x", "y", "z"),
        (2, "", "en", "a", None, None, None),
        (3, " \t\n ", "en", "a", None, None, None),
        (4, LONG, "en", "b", None, None, None),
        (5, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY 4.0.", "en", "b", None, None, None),
        (5, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY 4.0.", "en", "b", None, None, None),
        (None, "All rights\nreserved. É cc-by", "fr", None, None, None, None),
        (None, "all RIGHTS reserved", None, "c", None, None, None),
        (9, "\x00 # * $ 1", "de", "c", None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- hashing


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\né", max_size=30)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_split(texts):
    blobs = [None if t is None else t.encode() for t in texts]
    w = Words(blobs)
    split = [(b or b"").split() for b in blobs]
    assert w.counts.tolist() == [len(x) for x in split]
    assert [w.data[s:e] for s, e in zip(w.starts, w.ends)] == [x for y in split for x in y]
    by_word = {}
    for x, h in zip((x for y in split for x in y), w.hashes().tolist()):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_window_hashes_follow_content():
    w = Words([b"a b c d a b c", b"x a b c"])
    starts, inside = window_starts(w.counts, 3)
    for kind in (0, 1):
        h = window_hashes(w.hashes(kind), starts, 3, kind)
        assert h[0] == h[4] == h[6] and len(set(h.tolist())) == 5
    assert inside.tolist() == [0, 1, 2, 3, 4, 0, 1]


def _thue_morse(k):
    s = "a"
    for _ in range(k):
        s += s.translate({97: 98, 98: 97})
    return s, s.translate({97: 98, 98: 97})


def test_hashes_tell_patterned_and_long_words_apart():
    words = [w for k in range(1, 15) for w in _thue_morse(k)] + ["x" * n for n in range(1, 200)] + ["x" * n + "y" for n in range(200)] + ["x" * 8 + "y" * 8, "y" * 8 + "x" * 8]
    assert len(set(words)) == len(words)
    both = Words([" ".join(words).encode()])
    assert len(set(both.hashes(0).tolist())) == len(set(both.hashes(1).tolist())) == len(words)
    assert not set(both.hashes(0).tolist()) & set(both.hashes(1).tolist())
    # a word's hash doesn't hang on what stands around it
    assert all(Words([w.encode()]).hashes(lane)[0] == h for lane in (0, 1) for w, h in zip(words, both.hashes(lane)))


def test_packets_grow_with_the_input_not_with_its_square():
    rng = np.random.default_rng(0)
    sent = {}
    for groups in (8, 32, 128):
        # buckets grow with the input, as in the operators
        distinct = [np.unique(rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)) for _ in range(groups)]
        sent[groups] = sum(len(list(packed(keys, 100 * groups))) for keys in distinct)
        assert sent[groups] <= sum(map(len, distinct))
    assert sent[128] <= 4.5 * sent[32] and sent[32] <= 6 * sent[8]
    assert group_size(10**9, 4 << 20) == 4 << 20 and group_size(10**14, 4 << 20) == 32 << 20


# -- licenses


def test_licenses_odd_inputs(spark):
    rows = {(r.doc_id, r.n_words): r for r in licenses.scan(odd(spark)).collect()}
    assert licenses.scan(odd(spark)).count() == 9
    assert rows[1, 0].labels == "" and rows[1, 0].score == 0 and rows[1, 0].first_word is None
    five = rows[5, 18]
    assert five.base_labels == "cc-by,gpl" and "gpl-3.0" in five.labels and "cc-by-4.0" in five.labels
    assert (five.n_base, five.first_word, five.last_word, five.score) == (2, 7, 14, 1.0)
    assert rows[None, 6].base_labels == "cc-by,reserved" and rows[None, 3].base_labels == "reserved"
    assert licenses.scan(empty(spark)).count() == 0


def test_licenses_tolerate_missing_tokens(spark):
    text = dict(licenses.TEMPLATES)["mit-grant"].split()
    cases = [(i, " ".join(["pad"] * n + text[:k] + text[k + 2 :])) for i, (n, k) in enumerate([(0, 1), (50, 3), (95, 10)])]
    cases.append((9, " ".join(text[: len(text) // 2])))
    df = spark.createDataFrame(cases, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df).collect()}
    assert all("mit-grant" in got[i][0] and got[i][1] >= 0.9 for i in range(3)) and got[9] == ("", 0.0)


def test_licenses_whole_texts_and_larger_templates(spark):
    rng = np.random.default_rng(7)
    text = dict(licenses.TEMPLATES)["mit-text"].split()
    for k in (20, 77, 130):
        text[k] = "changed"
    pad = [f"p{x}" for x in rng.integers(0, 10**6, 300)]
    cases = [(i, " ".join(pad[:n] + text + pad[n:])) for i, n in enumerate((0, 130, 299))]
    cases += [(7, " ".join(pad + text[:80])), (8, "this is licensed under CC BY SA 4.0"), (9, "this is licensed under CC BY 4.0")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert all("mit-text" in got[i].labels.split(",") for i in range(3)) and "mit-text" not in got[7].labels
    assert got[8].labels == "cc-by,cc-by-sa-4.0" and got[9].labels == "cc-by,cc-by-4.0"


# -- quality


def _stats(t):
    w = WORD.findall(t or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_statistics(spark):
    texts = [None, "", "a b c a b c", "a a a a", "x\nx\n \n \ny\nx", "é# ß$|<> ab", "a b c d a b c e b c d", LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(df, quality.DecisionList()).collect():
        s = r.stats
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == _stats(texts[r.row.doc_id])
        assert r.base_failed == (s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words) and r.kept == (not r.base_failed)


def test_quality_odd_inputs(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 0, 0), (9, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality(odd(spark), labels).select("row.*", "kept").count() == 9
    assert quality.quality(empty(spark), labels).count() == 0
    assert quality.quality(odd(spark), labels.limit(0)).where("kept").count() == 1


def test_quality_learns_and_keeps_clean_texts(spark):
    rng = np.random.default_rng(1)
    good = [(i, " ".join(f"word{x}" for x in rng.integers(0, 5000, 120)) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(f"word{x}***" for x in rng.integers(0, 5000, 120))) for i in range(120)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    rules = quality.fit(df, labels)
    assert rules.rules and "reject" in str(rules)
    kept = {r.doc_id for r in quality.judge(df, rules).where("kept").select("row.doc_id").collect()}
    assert kept == {i for i, _ in good}


# -- decontamination


def _norm(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def _best(words, item):
    best = 0
    for diagonal in range(-len(item), len(words)):
        cur = 0
        for p, x in enumerate(item):
            same = 0 <= diagonal + p < len(words) and words[diagonal + p] == x
            cur = max(0, cur + (1 if same else -2))
            best = max(best, cur)
    return best


def test_contamination_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary, 15 + 3 * i))) for i in range(10)] + [(10, None), (11, "too short")]
    docs = []
    for i in range(60):
        words = list(rng.choice(vocabulary, 150))
        if i % 2:
            item = items[i % 10][1].split()
            part = item[: max(12, len(item) * (1 + i % 3) // 3)]
            for k in range(6, len(part), 7):
                part[k] = "changed" if i % 4 == 1 else part[k]
            at = int(rng.integers(0, 150))
            words[at:at] = [w.upper() + "," for w in part]
        docs.append((i, " ".join(words)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {i: {b for b, t in items if len(_norm(t)) >= 8 and _best(_norm(x), _norm(t)) >= min(10, len(_norm(t)))} for i, x in docs}
    got = {r.doc_id: r for r in decontam.contamination(df, bench).collect()}
    assert {i: r.contaminated for i, r in got.items()} == {i: bool(s) for i, s in want.items()}
    assert all(got[i].n_items == len(s) and (got[i].item_id in s or not s) for i, s in want.items())
    assert sum(map(bool, want.values())) >= 25
    kept = {r.doc_id for r in decontam.remove_contaminated(df, bench).collect()}
    assert kept == {i for i, s in want.items() if not s}


def test_contamination_recall_by_distance_of_substitutions(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(2000)]
    items = [(f"item-{i}", " ".join(rng.choice(vocabulary, 60))) for i in range(12)]
    docs, want = [], []
    for period in range(3, 9):
        for i, (_, t) in enumerate(items):
            part = t.split()
            for k in range(int(rng.integers(0, period)), len(part), period):
                part[k] = str(rng.choice(vocabulary)) if i % 2 else "changed"
            docs.append((f"{period}-{i}", " ".join([*rng.choice(vocabulary, 40), *part, *rng.choice(vocabulary, 40)])))
            want.append(_best(part, t.split()) >= 10)
    assert sum(want) >= 55
    df, bench = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r.contaminated for r in decontam.contamination(df, bench).collect()}
    assert not any(got[i] for (i, _), w in zip(docs, want) if not w)
    assert sum(got[i] for (i, _), w in zip(docs, want) if w) >= 0.9 * sum(want)
    for period in range(4, 9):
        own = [got[i] for (i, _), w in zip(docs, want) if w and i.startswith(f"{period}-")]
        assert sum(own) >= 0.9 * len(own)


def test_contamination_compares_whole_items(spark):
    words = [f"q{i}" for i in range(400)]
    short = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, "a b " + " ".join(words)), (2, " ".join(words[:250]) + " x " + " ".join(words[251:])), (3, f"see {short}"), (4, short[4:])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words)), (2, short), (3, " ".join(words))], "item_id int, text string")
    got = {r.doc_id: (r.contaminated, r.n_items, r.item_id, r.overlap) for r in decontam.contamination(df, bench).collect()}
    assert got == {1: (True, 2, 1, 400), 2: (True, 2, 1, 399), 3: (True, 1, 2, 8), 4: (False, 0, None, 0)}


def test_contamination_large_vocabulary_and_shuffle_join(spark, monkeypatch):
    text = " ".join(f"q{i}" for i in range(40))
    df = spark.createDataFrame([(1, "a b " + text), (2, "nothing here at all")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    monkeypatch.setattr(decontam, "PAIRS", 3)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 1)
    assert {r.doc_id: (r.contaminated, r.overlap) for r in decontam.contamination(df, bench).collect()} == {1: (True, 40), 2: (False, 0)}


def test_contamination_odd_inputs(spark):
    bench = spark.createDataFrame([(1, "x y z"), (2, None)], "item_id long, text string")
    assert decontam.contamination(odd(spark), bench).where("contaminated").count() == 0
    assert decontam.contamination(odd(spark), bench.limit(0)).count() == 9
    assert decontam.contamination(empty(spark), bench).count() == 0
    assert decontam.remove_contaminated(odd(spark), bench).count() == 9


# -- repeated passages


def _removed(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 4, 7])
@pytest.mark.parametrize("buckets", [2_000_000, 20])
def test_repeats_match_brute_force(spark, window, buckets):
    rng = np.random.default_rng(window)
    texts = [None, "", " ", "a"] + [" ".join(rng.choice(["a", "b", "c", "dé"], rng.integers(1, 40))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, window=window, group_bytes=200, bucket_words=buckets).collect()}
    for i, (n, k, kept) in enumerate(_removed(texts, window)):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, k, hashlib.sha256(kept.encode()).hexdigest())
        assert (r.text is None) == (texts[i] is None) and WORD.findall(r.text or "") == kept.split()
        assert k or r.text == texts[i]


def test_passages_that_differ_in_one_patterned_word_stay(spark):
    for k in (10, 12):
        first, second = (" ".join([f"u{i}" for i in range(17)] + [w] + [f"v{i}" for i in range(17)]) for w in _thue_morse(k))
        df = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
        assert [r.n_removed for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]


def test_repeats_odd_inputs(spark):
    out = substring_dedup.remove_repeats(odd(spark))
    assert out.count() == 9 and {"source", "labels", "row", "n_words"} <= set(out.columns)
    assert dict(out.dtypes)["n_words"] == "bigint"
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, " ".join(f"u{i}" for i in range(50)))] * 2, "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(twice).collect()] == [50, 50]
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(twice, window=0)


# -- language


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "▁", "▁a", "▁ab"]
    ids = {p: i for i, p in enumerate(pieces)}
    probs = np.array([[0.1], [0.2], [0.05], [0.3], [0.07], [0.03], [0.25]])
    ways = {"ab": [("▁", "a", "b"), ("▁a", "b"), ("▁ab",), ("▁", "ab")], "ax": [("▁", "a", None), ("▁a", None)]}
    lattice = langid.Lattice(list(ways), langid.prefix_table(pieces), len(pieces))
    want = [sum(math.prod(probs[ids.get(p, 6), 0] for p in way) for way in ways[w]) for w in ways]
    assert np.allclose(lattice.totals(probs)[:, 0], want) and np.allclose(lattice.backward(probs)[:, 0, 0], want)


def test_words_are_letters():
    assert langid.words_of("Añb ½ ² ① Ⅷ x²y a_b 3c4 ĳ") == ["añb", "x", "y", "a", "b", "c", "ĳ"]


def _ways(word, pieces):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in pieces or k == 1:
            for rest in _ways(word[k:], pieces):
                yield (word[:k], *rest)


def test_prediction_matches_all_segmentations(spark):
    rng = np.random.default_rng(5)
    pieces = ["a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "▁b", "▁ab"]
    probs = rng.dirichlet(np.ones(len(pieces) + 1), 2).T
    model = langid.Model(("l1", "l2"), tuple(pieces), probs)
    texts = [" ".join("".join(rng.choice(list("abcx"), rng.integers(1, 7))) for _ in range(rng.integers(1, 6))) for _ in range(40)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    ids = {p: i for i, p in enumerate(pieces)}
    for i, t in enumerate(texts):
        sums = [sum(math.log(sum(math.prod(probs[ids.get(p, len(pieces)), k] for p in way) for way in _ways("▁" + w, ids))) for w in t.split()) for k in (0, 1)]
        assert got[i].lang_pred == ("l1" if sums[0] >= sums[1] else "l2")
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-abs(sums[0] - sums[1]))))


def test_long_words_are_scored_whole():
    pieces = ["a", "b", "ab", "▁", "▁a"]
    probs = np.array([[0.1, 0.3], [0.2, 0.1], [0.05, 0.2], [0.3, 0.1], [0.07, 0.2], [0.25, 0.1]])
    scorer = langid.Model(("x", "y"), tuple(pieces), probs).scorer()
    for w in ("ab" * 20, "abx"):
        assert np.allclose(langid.log_total(w, scorer.pieces, probs), np.log(langid.Lattice([w], scorer.pieces, 5).totals(probs))[0])
    long = scorer.of_words(["ab" * 40_000, "abab"])
    assert np.isfinite(long).all() and long[0, 1] > long[0, 0]
    # the growth of one more syllable is the same however long the word is
    assert np.allclose(langid.log_total("ab" * 301, scorer.pieces, probs) - langid.log_total("ab" * 300, scorer.pieces, probs), langid.log_total("ab" * 1001, scorer.pieces, probs) - langid.log_total("ab" * 1000, scorer.pieces, probs))


def test_languages_of_rows_without_or_with_one_key_are_learned(spark):
    rng = np.random.default_rng(2)

    def text(letters):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))

    rows = [(None, text("abcd"), "en") for _ in range(60)] + [(7, text("abcd"), "en") for _ in range(60)] + [(i, text("efgh"), "fr") for i in range(20)] + [(None, text("ijkl"), "xx") for _ in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, sample=25)
    assert model.languages == ("en", "fr", "xx")
    named = spark.createDataFrame([(lang, t) for _, t, lang in rows], "doc_id string, text string")
    assert all(r.lang_pred == r.doc_id for r in langid.predict(named, model).collect())
    odd_ones = spark.createDataFrame([(1, "½ ² ① Ⅷ", "en"), (2, "¾", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(odd_ones, model).collect()} == {"und"}


def test_language_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_language_odd_inputs(spark):
    rows = langid.identify(odd(spark)).collect()
    assert len(rows) == 9 and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 9)} == {"und"}
    assert langid.identify(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(none).collect()] == [("und", 0.0)]


# -- scoring


def test_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = lm.score(docs, group_bytes=40_000, bucket_words=5000).collect()
    tokens = {i: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t)] + [None] for i, t in texts.items()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    c = Counter(x for i in train for x in tokens[i])
    n, v = sum(c.values()), len(c)
    for r in rows:
        assert r.held_out == (r.doc_id not in train) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(tokens[r.doc_id]), sum(c[x] > 0 for x in tokens[r.doc_id]))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens[r.doc_id]))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_match_the_model_token_by_token(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    shape = lm.Shape(features=256, member_features=512)
    got = {r.doc_id: r for r in lm.score(frame, shape=shape, group_bytes=30_000, bucket_words=2000).collect()}
    again = {r.doc_id: r.score for r in lm.score(frame.repartition(7), shape=shape, group_bytes=30_000, bucket_words=2000).collect()}
    assert again == {i: r.score for i, r in got.items()}
    own = frame.withColumn("train", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0)
    totals = lm.gathered(lm.token_counts(own.where("train")))
    total = sum(len(t.encode()) for t in texts.values())
    members = lm.Members(list(totals.alone))
    w = lm.train(lm.dealt(own, "text", total, 30_000, [F.col("doc_id")]), members, shape)
    counts = Counter(k for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for k in lm.Tokens([t.encode()]).keys.tolist())
    assert totals.tokens == sum(counts.values()) and totals.kinds == len(counts)
    for i in list(texts)[:20]:
        t = lm.Tokens([texts[i].encode()])
        m = members.of(t.keys)
        first, then = t.rows(shape, m)
        want = 0.0
        for n, k in enumerate(t.keys.tolist()):
            for rows, target in ((first[n], m[n] % 16), (then[n], m[n] // 16)):
                z = [sum(float(w[r, c]) for r in rows) for c in range(16)]
                want += (z[target] - math.log(sum(map(math.exp, z)))) / math.log(10)
            if k not in totals.alone:
                peers = [c for x, c in counts.items() if x not in totals.alone and x % lm.GROUPS == k % lm.GROUPS]
                want += math.log10((counts[k] + 0.1) / (sum(peers) + 0.1 * (len(peers) + 1)))
        assert got[i].score == pytest.approx(want, rel=1e-4)


def test_probabilities_of_all_words_sum_to_one():
    shape = lm.Shape(features=64, member_features=64)
    rng = np.random.default_rng(0)
    t = lm.Tokens([b"A b c", None, b"", b"d " * 50])
    assert t.counts.tolist() == [4, 1, 1, 51]
    alone = list(dict.fromkeys(t.keys.tolist()))[:3]
    members = lm.Members(alone)
    m = members.of(t.keys)
    assert [m[t.keys == a].tolist()[0] for a in alone] == [0, 1, 2] and (m[~np.isin(t.keys, alone)] >= lm.ALONE).all()
    w = rng.normal(size=(shape.rows, lm.CLASSES)).astype(np.float32)
    # every member in turn as the third token, after one and the same history
    first, total = t.rows(shape, m)[0], 0.0
    for member in range(lm.MEMBERS):
        m[2] = member
        total += 10 ** lm.history_logs(w, first[2:3], t.rows(shape, m)[1][2:3], m[2:3])[0]
    assert total == pytest.approx(1, abs=1e-4)


def test_gradient_is_that_of_the_likelihood():
    shape = lm.Shape(features=8, member_features=8, batch=64)
    t = lm.Tokens([b"a b c d e f g h i j"])
    m = lm.Members(t.keys.tolist()).of(t.keys)
    rows, w = t.rows(shape, m)[0], np.zeros((shape.rows, lm.CLASSES), np.float32)

    def loss(x):
        return -lm.log_classes(x, rows)[np.arange(len(rows)), m % lm.CLASSES].sum()

    trainer = lm.Trainer(w, shape)
    for _ in range(20):
        trainer.learn(rows, m % lm.CLASSES)
    assert loss(trainer.w) < 0.3 * loss(w)


def test_scores_odd_inputs(spark):
    rows = lm.score(odd(spark)).collect()
    assert len(rows) == 9 and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert not any(r.held_out for r in rows if r.doc_id is None) and all(np.isfinite(r.score) for r in rows)
    assert lm.score(empty(spark)).count() == 0


# -- mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(1, 20))
@settings(max_examples=50, deadline=None)
def test_splits_are_exact(quotas, shards):
    out = mixing.split_quotas(quotas, shards, 1)
    assert out.sum(axis=0).tolist() == quotas and (out >= 0).all()
    sizes = out.sum(axis=1)
    assert sizes.max() - sizes.min() <= math.ceil(math.log2(shards)) + 1


def test_mix_meets_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.taken(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    sources = {r.source for r in rows}
    for s in sources:
        own = [r for r in rows if r.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
    again = {r.doc_id: r.taken for r in mixing.taken(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    drawn = mixing.mix(docs)
    counts = {r.doc_id: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    assert all(counts.get(r.doc_id, 0) * r.size == r.taken for r in rows)
    places = drawn.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("position").alias("p"), F.max("position").alias("m")).collect()
    assert all(r.n == r.p == r.m + 1 for r in places)


def test_every_planned_block_is_drawn(spark):
    rng = np.random.default_rng(6)
    rows = [(s, b, int(w)) for s, n in (("a", 40), ("b", 300), (None, 120)) for b, w in enumerate(rng.integers(1, 400, n))]
    sources, draws, _ = mixing.plan(spark.createDataFrame(rows, "source string, block int, words long"), shards=7)
    words = {(s, b): w for s, b, w in rows}
    of = {r.sid: (r.source, r.target) for r in sources.collect()}
    got = [(of[r.sid][0], r.block, r.copy) for r in draws.collect()]
    assert len(got) == len(set(got))
    for s, target in of.values():
        assert abs(sum(words[x, b] for x, b, _ in got if x == s) - target) <= 20
    assert of[0][0] == "a" and of[2][0] is None and of[0][1] == 3 * sum(w for s, _, w in rows if s == "a")


def test_a_block_that_does_not_fit_is_passed_over(spark):
    rng = np.random.default_rng(3)
    for long in (20_000,):
        rows = [(s, b, int(w)) for s in "abc" for b, w in enumerate([*rng.integers(100, 500, 300), long])]
        words = {(s, b): w for s, b, w in rows}
        for seed in range(2):
            sources, draws, _ = mixing.plan(spark.createDataFrame(rows, "source string, block int, words long"), shards=3, seed=seed)
            of = {r.sid: (r.source, r.target) for r in sources.collect()}
            got = [(of[r.sid][0], r.block, r.copy) for r in draws.collect()]
            assert len(got) == len(set(got))
            for s, target in of.values():
                taken = [b for x, b, _ in got if x == s]
                miss = target - sum(words[s, b] for b in taken)
                # either close to the target, or no block that fits is left
                left = [w for (x, b), w in words.items() if x == s and taken.count(b) < max(map(taken.count, taken))]
                assert abs(miss) <= 100 or miss < min(left, default=math.inf)


def test_repeated_and_null_keys_are_drawn_one_by_one(spark):
    rows = [(None, f"a{i} b c d e f g h i j", "s") for i in range(40)] + [(5, "x y z", "r")] * 30 + [(i, "w " * 80, "t") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 7):
        found = mixing.taken(df.repartition(parts)).collect()
        assert len(found) == 100
        by = {}
        for r in found:
            by.setdefault((r.source_size, r.target), []).append(r.taken)
        for (size, target), taken in by.items():
            assert abs(sum(taken) - target) <= {400: 10, 90: 3, 2400: 80}[size]
        again = sorted((r["size"], r.taken) for r in found)
        assert parts == 1 or again == first
        first = again


def test_subtrees_are_those_of_the_whole_tree(spark):
    quotas, shards = [100, 0, 7, 1000], 37
    whole = mixing.split_quotas(quotas, shards, 3)
    for cells in (4, 40, 4000):
        got = np.zeros_like(whole)
        for r in mixing._ranges(spark, quotas, shards, 3, cells).collect():
            got[r.shard, r.sid] = r.end - r.begin
            assert r.begin == whole[: r.shard, r.sid].sum()
        assert (got == whole).all()


def test_mix_odd_inputs(spark):
    rows = mixing.taken(odd(spark)).collect()
    assert len(rows) == 9 and all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.taken(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    assert set(mixing.mix(odd(spark)).columns) >= {"labels", "copy", "shard", "position"}


CLASHES = ("key", "mark", "_key", "_mark", "_source", "g", "of", "at", "sid", "size", "block", "copy", "stats", "words", "kept", "first")


def test_clashing_columns_ride_along(spark):
    docs = odd(spark).select("doc_id", "text", "source", *(F.lit(c).alias(c) for c in CLASHES))
    bench = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0, "k")], "doc_id long, quality int, toxic int, stats string")
    for out in (substring_dedup.remove_repeats(docs), decontam.remove_contaminated(docs, bench), simhash.keep_one(docs), mixing.mix(docs), quality.quality(docs, labels).select("row.*")):
        assert set(docs.columns) <= set(out.columns)
        for r in out.select(*CLASHES).distinct().collect():
            assert all(r[c] == c for c in CLASHES if c != "copy")
    assert licenses.scan(docs).count() == langid.identify(docs.withColumn("lang", F.lit("en"))).count() == lm.score(docs).count() == mixing.taken(docs).count() == 9
