"""Whitening, clustering and MinHash near-duplicates against brute force, and odd rows."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import clustering, minhash, queries, whitening

VECTORS = "vec_id long, embedding array<float>"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], VECTORS).repartition(parts)


def odd(good):
    """Rows that both operators leave out, and repeated ones, beside ``good`` ones."""
    size = len(good[0])
    bad = [None, [], [None] * size, [*good[0][1:], math.nan], [*good[0][1:], math.inf], [*good[0][1:], -math.inf]]
    return [(i, v) for i, v in enumerate(good)] + [(0, good[0]), (None, good[1])] + [(1000 + i, v) for i, v in enumerate(bad)]


# -- whitening


def test_chan_merging_equals_the_whole_in_any_order():
    rng = np.random.default_rng(0)
    x = rng.integers(10**9, 10**9 + 50, (200, 6))
    parts = [whitening._part(p) for p in np.array_split(x, 9)]
    zero = (0, np.zeros(6, object), np.zeros((6, 6)))
    for order in (range(9), rng.permutation(9)):
        n, sums, scatter = zero
        for i in order:
            n, sums, scatter = whitening.merge(whitening.merge((n, sums, scatter), parts[i]), zero)
        assert n == 200 and sums.tolist() == [int(v) for v in x.sum(axis=0)]
        c = x - x.mean(axis=0)
        assert np.allclose(scatter, c.T @ c, rtol=1e-12, atol=1e-6)


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_against_numpy(spark, parts):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 3).astype(np.float32)
    df = vectors(spark, odd(good.tolist()), parts)
    rows = whitening.whiten(df, components=3).collect()
    x = np.floor(1024 * np.concatenate([good, good[:2]]).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    want = ((x - s / n) @ axes[:, ::-1] / np.sqrt(values[::-1]))[:, :3]
    assert len(rows) == n == rows[0].n
    by_key = {r.vec_id: r for r in rows}
    signs = np.sign(np.array(by_key[5].whitened) * want[5])
    for i in (0, 7, 299):
        assert np.allclose(by_key[i].whitened, want[i] * signs, atol=1e-8)
        assert by_key[i].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
    assert np.allclose(by_key[None].whitened, by_key[1].whitened) and sum(r.vec_id == 0 for r in rows) == 2
    assert np.allclose(rows[0].explained, values[::-1][:3] / values.sum(), rtol=1e-9)
    own = np.array([r.whitened for r in rows])
    assert np.abs(np.cov(own.T, bias=True) - np.eye(3)).max() < 1e-9 and rows[0].identity_error < 1e-9


def test_identity_error_tells_a_wrong_fit(spark):
    good = np.random.default_rng(2).normal(size=(50, 3)).tolist()
    df = vectors(spark, list(enumerate(good)))
    model, size = whitening.fit(df)
    wrong = whitening.Whitening(model.n, model.sums, model.directions, model.variances * 1.5, model.total)
    assert whitening.identity_error(df, model, size) < 1e-10 < 0.3 < whitening.identity_error(df, wrong, size)


def test_whitening_of_odd_tables(spark):
    none = vectors(spark, [])
    assert whitening.whiten(none).collect() == [] == whitening.whiten(vectors(spark, [(1, None), (2, [math.nan])])).collect()
    one = whitening.whiten(vectors(spark, [(1, [0.5, 2]), (1, [0.5, 2])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(2, 0, [], [], 0.0)] * 2
    # a line has one component; the most frequent length counts, of equally frequent ones the larger
    line = whitening.whiten(vectors(spark, [(i, [i, 2 * i]) for i in range(9)] + [(20 + i, [i]) for i in range(8)])).collect()
    assert {r.vec_id for r in line} == set(range(9)) and all(len(r.whitened) == 1 for r in line) and abs(line[0].explained[0] - 1) < 1e-12
    assert {r.vec_id for r in whitening.whiten(vectors(spark, [(1, [1]), (2, [1, 2])])).collect()} == {2}
    # huge values: deviations that fit no 64-bit number are null, nothing overflows
    huge = {r.vec_id: r for r in whitening.whiten(vectors(spark, [(1, [1e30, 0]), (2, [-1e30, 0]), (3, [0, 1])])).collect()}
    assert huge[1].deviation is None and all(map(math.isfinite, huge[1].whitened))
    clash = vectors(spark, [(1, [1, 2]), (2, [2, 1]), (3, [5, 5])]).select("*", *(F.lit("x").alias(c) for c in ("key", "x", "n", "part", "whitened", "deviation")))
    assert len(whitening.whiten(clash).collect()) == 3


def test_large_numbers_are_summed_exactly():
    x = np.array([[2**46, 3], [2**46, -(2**46)], [1, 5]] * 1000, np.int64)
    assert whitening._exact_sum(x).tolist() == [1000 * (2**47 + 1), 1000 * (8 - 2**46)]
    model = whitening.Whitening(3000, whitening._exact_sum(x), np.eye(2), np.ones(2), 1.0)
    assert model.deviations(x[:1]) == [None] and abs(model.centred(x[:1])[0, 0] - float(2**46 - Fraction(2**47 + 1, 3))) < 1e-2


# -- clustering


def lloyd(rows, clusters, rounds, seed=2, scale=256):
    """(key, vector) rows clustered by comparing all with all, over Python's numbers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [(nearest(v)[1], v) for _, v in kept]
        centroids = [[sum(col) // len(m) for col in zip(*m)] if (m := [v for c, v in own if c == i]) else centroids[i] for i in range(len(centroids))]
    return sorted((repr(i), *nearest(v)[::-1]) for i, v in kept), centroids


@pytest.mark.parametrize("spread", [0, 1, 30])
def test_annulus_search_is_exact(spread):
    rng = np.random.default_rng(spread)
    # many ties: few values, equal centroids, equal norms
    centroids = rng.integers(-2, 3, (50, 4)) * (1 + spread)
    x = rng.integers(-3, 4, (3000, 4)) * (1 + spread) + rng.integers(-1, 2, (3000, 4)) * (spread > 0)
    number, distance = clustering.Annulus(centroids).nearest(x)
    every = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    large = np.array([[clustering.LIMIT, -clustering.LIMIT], [clustering.LIMIT, clustering.LIMIT], [clustering.LIMIT - 1, clustering.LIMIT]])
    assert clustering.Annulus(large).nearest(large)[1].tolist() == [0, 0, 0]
    assert clustering.Annulus(large[:1]).nearest(large[1:2])[1].tolist() == [4 * clustering.LIMIT**2]


def test_few_centroids_are_compared():
    """Where norms differ the annulus leaves a few of the centroids."""
    rng = np.random.default_rng(5)
    centroids = rng.integers(1, 100, (400, 1)) * rng.integers(900, 1000, (400, 3))
    seen = []

    class Counting(clustering.Annulus):
        def _squared(self, x, squares, some):
            if isinstance(some, slice):
                seen.append(len(x) * (some.stop - some.start))
            return super()._squared(x, squares, some)

    x = rng.integers(1, 100, (5000, 1)) * rng.integers(900, 1000, (5000, 3))
    number, _ = Counting(centroids).nearest(x)
    assert (number == ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(seen) < 0.3 * len(x) * len(centroids)


def test_clustering_against_brute_force(spark):
    rng = np.random.default_rng(3)
    good = np.round(rng.normal(size=(150, 6)) * 2).tolist()
    df = vectors(spark, odd(good) + [(2000, [1.0] * 5)]).select("*", *(F.lit("x").alias(c) for c in ("key", "x", "cluster", "distance", "place", "total")))
    found = clustering.cluster(df, clusters=9, rounds=3, size=6).collect()
    want, centroids = lloyd([(i, v) for i, v in odd(good) if i is None or i < 1000], 9, 3)
    assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in found) == want
    assert all(r.centroid == centroids[r.cluster] for r in found)
    assert {r.inertia for r in found} == {sum(d for _, _, d in want)}
    for r in found:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)


def test_clustering_of_odd_tables(spark):
    assert clustering.cluster(vectors(spark, [])).collect() == [] == clustering.cluster(vectors(spark, [(1, None), (2, [1.0])]), size=2).collect()
    few = clustering.cluster(vectors(spark, [(1, [1, 1]), (2, [1, 1]), (3, [9e30, 0])]), size=2).collect()
    assert sorted((r.vec_id, r.distance) for r in few) == [(1, 0), (2, 0), (3, 0)]
    assert len({r.cluster for r in few if r.vec_id < 3}) == 1


# -- MinHash


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def grams(text, n=2):
    w = words_of(text)
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def expected(docs, similarity=80, shingle=2):
    """{doc_id: (n_shingles, component)} by comparing all with all."""
    sets = {i: grams(t, shingle) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def as_told(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_shingle_sets():
    texts = [None, "", " \t", "one", "One", "a b", "a b a b a", "x\ty z\x0b\x0c\r\nX é É", "a b c"]
    sets, hashes = minhash.shingle_sets([None if t is None else t.encode() for t in texts])
    assert [int((sets == i).sum()) for i in range(len(texts))] == [len(grams(t)) for t in texts]
    own = [set(hashes[sets == i].tolist()) for i in range(len(texts))]
    assert own[3] == own[4] and own[5] < own[6] and own[5] < own[8]


@pytest.mark.parametrize("n", [1, 7, 100, 40_000])
def test_signatures_are_those_of_one_element_after_the_other(n):
    """Breadth first and with early stopping the places hold what single elements with full permutations offer."""
    places, rng = 24, np.random.default_rng(n)
    elements = rng.integers(0, 2**63, n).astype(np.uint64)
    got = minhash.super_minhash(np.zeros(n, np.int64), elements, 1, places)[0]
    some = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    for e in elements[:2000]:
        one = minhash.super_minhash(np.zeros(1, np.int64), np.array([e]), 1, places)[0]
        # each element ranks all places, each rank once
        assert sorted((one >> np.uint64(54)).tolist()) == list(range(places))
        some = np.minimum(some, one)
    assert (got <= some).all() and (n > 2000 or (got == some).all())


def test_signatures_estimate_the_similarity_with_less_variance():
    rng = np.random.default_rng(4)
    places, runs, s, n = 64, 400, 0.5, 30
    shared = n * 2 // 3  # two sets of 30 with 20 in common: 20 / 40
    found = []
    for _ in range(runs):
        e = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        a, b = e[:n], np.concatenate([e[:shared], e[n:]])
        x = minhash.super_minhash(np.repeat([0, 1], n), np.concatenate([a, b]), 2, places)
        found.append((x[0] == x[1]).mean())
    assert abs(np.mean(found) - s) < 0.01
    # independent places have s * (1 - s) / places
    assert np.var(found) < 0.85 * s * (1 - s) / places


def test_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(6)
    docs, word = [], [f"w{i}" for i in range(3000)]
    for _ in range(60):
        base = rng.choice(word, rng.integers(3, 120)).tolist()
        for _ in range(rng.integers(1, 6)):
            own = list(base)
            for _ in range(rng.integers(0, 1 + len(own) // 12)):
                own[rng.integers(len(own))] = str(rng.choice(word))
            docs.append(" ".join(own))
    docs = list(enumerate(docs, 1))
    rng.shuffle(docs)
    docs = [(int(i), str(t)) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = expected(docs)
    assert any(i != c for i, (_, c) in want.items())
    for limit in (4096, 3):
        assert as_told(minhash.near_duplicates(df, cell_limit=limit)) == want


def test_ties_at_the_threshold_are_links(spark):
    # 8 of 10 shingles in common, 79 of 99, 4 of 5
    a, b = [f"a{i}" for i in range(10)], [f"b{i}" for i in range(89 + 1)]
    docs = [(1, " ".join(a)), (2, " ".join(a[:9] + ["z"])), (3, " ".join(b)), (4, " ".join(b[:80] + [f"q{i}" for i in range(10)])), (5, "one two three four five"), (6, "One two three four five six")]
    assert as_told(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == expected(docs)


def test_a_large_loose_group_loses_no_link(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(150):
        own = list(base)
        for k in rng.choice(60, 4, replace=False):
            own[k] = f"x{i}-{k}"
        docs.append((i, " ".join(own)))
    assert as_told(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == expected(docs)


def test_minhash_of_odd_rows(spark):
    long = " ".join(f"w{x}" for x in np.random.default_rng(1).integers(0, 10**6, 60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, long.upper()), (6, "one"), (7, "ONE"), (8, "one one"), (9, "a b"), (9, "a b"), (9, "c d"), (None, "a b"), (None, "a b"), (12, "É b"), (13, "é b")]
    df = spark.createDataFrame([(i, t, "k", "m", "s") for i, t in rows], "doc_id long, text string, key string, mark string, digest string")
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    size = len(grams(long))
    want = [("1", 0, 1, True), ("2", 0, 2, True), ("3", 0, 3, True), ("4", size, 4, True), ("5", size, 4, False), ("6", 1, 6, True), ("7", 1, 6, False), ("8", 1, 8, True), ("9", 1, 9, True), ("9", 1, 9, True), ("9", 1, 9, True), ("None", 1, None, True), ("None", 1, None, True), ("12", 1, 12, True), ("13", 1, 13, True)]
    assert got == sorted(want)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_whole_table_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert as_told(queries.op13_minhash_dedup(spark, small)) == expected(docs)
    found = queries.op11_embedding_whitening(spark, small)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.groupBy("vec_id").count().where("count <> 8").isEmpty() and found.where("identity_error > 0.0001").isEmpty()
