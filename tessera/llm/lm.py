"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(member | class, history) + log P(word | member).

The most frequent training tokens, the text's end among them, are members on their own; all other
words share members by a hash of their last two bytes, so unseen words have one too. Members are
dealt to classes by frequency. Both softmaxes select weights by hashed features of the history:
the previous word (bigram), the previous two (trigram), the word before the previous one (skip)
and the groups of both; for the second each feature is joined with the class. P(word | member) is 1
for a word on its own, else it comes from counts over *all* training tokens, smoothed like the base score.

Training: documents are dealt to groups by a hash, whatever their partitions. Each group runs
gradient updates (Adagrad, mini-batches) over all its training tokens from the common weights;
the groups' weights are averaged row by row, weighted by how often each row was updated. The weights
have a fixed size. Counts are gathered by packed exchange between document groups (see
``_exchange``), scores in numpy batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._exchange import dealt, from_low_bytes, group_size, in_order, low_bytes, packed, text_bytes
from tessera.llm._hashing import Words, mix, slices
from tessera.llm._storage import saved

U64 = np.uint64
#: Classes, and members of each class.
CLASSES = 16
MEMBERS = CLASSES * CLASSES
#: Members that share words by their last bytes; the rest are frequent tokens on their own.
GROUPS = 64
ALONE = MEMBERS - GROUPS
_SLICE = 1 << 20
_ROWS_A_BLOCK = 512
_END = U64(0)


@dataclass(frozen=True)
class Shape:
    """Sizes of the weight tables: rows for each of three hashed kinds of features of the classes (``features``) and of the members."""

    features: int = 4096
    member_features: int = 16384
    rate: float = 0.3
    batch: int = 8192
    rounds: int = 1

    @property
    def class_rows(self) -> int:
        return 3 * self.features + (CLASSES + 1) ** 2

    @property
    def rows(self) -> int:
        return self.class_rows + 3 * self.member_features + CLASSES * (CLASSES + 1) ** 2


class Members:
    """Which member each token key belongs to; ``alone`` are the keys of the frequent tokens, most frequent first."""

    def __init__(self, alone: list[int]) -> None:
        keys = np.array(alone, U64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = ALONE + (keys & U64(GROUPS - 1)).astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.order[at[hit]]
        return out


class Tokens:
    """Token keys (64-bit hashes; the low bits tell the last bytes) of several texts, each closed by an end token (0)."""

    def __init__(self, texts: list[bytes | None]) -> None:
        keys, counts = [], []
        for s in slices(texts, _SLICE):
            w = Words(texts[s], lower=True)
            tail = w.buf[w.ends - 1].astype(U64) if len(w) else np.zeros(0, U64)
            before = np.where(w.ends - w.starts > 1, w.buf[w.ends - 2], 0).astype(U64) if len(w) else tail
            kind = U64(1) + mix(tail + U64(256) * before) % U64(GROUPS - 1)
            keys.append((w.hashes() & ~U64(GROUPS - 1)) | kind)
            counts.append(w.counts)
        words, n = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, U64), (counts, np.int64)))
        self.counts = n + 1
        ends = np.cumsum(self.counts) - 1
        self.keys = np.zeros(int(self.counts.sum()), U64)
        inner = np.ones(len(self.keys), bool)
        inner[ends] = False
        self.keys[inner] = words
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def rows(self, shape: Shape, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, 4) rows of the weight table for the class, and for the member, that each token's history selects."""
        f, g, n = U64(shape.features), U64(shape.member_features), len(self.keys)
        start = np.concatenate([[0], np.cumsum(self.counts)[:-1]]) if len(self.counts) else np.zeros(0, np.int64)
        one, two = np.full(n, 1, U64), np.full(n, 2, U64)
        c1, c2 = np.full(n, CLASSES), np.full(n, CLASSES)
        own = members % CLASSES
        one[1:], c1[1:] = self.keys[:-1], own[:-1]
        two[2:], c2[2:] = self.keys[:-2], own[:-2]
        one[start], c1[start] = 1, CLASSES
        second = start[self.counts > 1] + 1
        for at in (start, second):
            two[at], c2[at] = 2, CLASSES
        first, then = np.empty((n, 4), np.int32), np.empty((n, 4), np.int32)
        turn = own.astype(U64) * U64(0xD1342543DE82EF95)
        pair = c1 * (CLASSES + 1) + c2
        for k, h in enumerate((mix(one), mix(one * U64(0x9E3779B97F4A7C15) + two), mix(two + U64(0x632BE59BD9B4E019)))):
            first[:, k] = k * shape.features + (h % f).astype(np.int32)
            then[:, k] = shape.class_rows + k * shape.member_features + (mix(h + turn) % g).astype(np.int32)
        first[:, 3] = 3 * shape.features + pair
        # every history has one of these, so they do a bias's work too
        then[:, 3] = shape.class_rows + 3 * shape.member_features + own * (CLASSES + 1) ** 2 + pair
        return first, then


def _scores(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the selected weights, the largest of each history 0."""
    z = weights[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        z += weights[rows[:, k]]
    z -= z.max(axis=1, keepdims=True)
    return z


def log_classes(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log of the probabilities of the classes, or of a class's members, for each history."""
    z = _scores(weights, rows)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


class Trainer:
    """Mini-batch Adagrad over the weight table."""

    def __init__(self, weights: np.ndarray, shape: Shape) -> None:
        self.w, self.shape = weights.astype(np.float32), shape
        self.square = np.full(shape.rows, 1e-3, np.float32)
        self.seen = np.zeros(shape.rows, np.float32)

    def learn(self, rows: np.ndarray, kinds: np.ndarray) -> None:
        for at in range(0, len(rows), self.shape.batch):
            r, k = rows[at : at + self.shape.batch], kinds[at : at + self.shape.batch]
            g = _scores(self.w, r)
            np.exp(g, out=g)
            g /= g.sum(axis=1, keepdims=True)
            g[np.arange(len(k)), k] -= 1
            for c in range(r.shape[1]):
                self._step(r[:, c], g)

    def _step(self, own: np.ndarray, g: np.ndarray) -> None:
        least = int(own.min())
        own = own - least
        # numbers of 16 bits are sorted by radix
        order = np.argsort(own.astype(np.uint16) if int(own.max()) < 1 << 16 else own, kind="stable")
        s = own[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        sums, hit = np.add.reduceat(g[order], first, axis=0), s[first] + least
        square = self.square[hit] + np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        self.square[hit] = square
        self.w[hit] -= sums * (self.shape.rate / np.sqrt(square))[:, None]
        self.seen[hit] += np.diff(np.append(first, len(s)))


def _taught(trainer: Trainer, texts: list[bytes | None], members: Members, shape: Shape) -> None:
    for s in slices(texts, _SLICE):
        t = Tokens(texts[s])
        m = members.of(t.keys)
        first, then = t.rows(shape, m)
        trainer.learn(first, m % CLASSES)
        trainer.learn(then, m // CLASSES)


def train(base: DataFrame, members: Members, shape: Shape) -> np.ndarray:
    """Weights after ``shape.rounds`` passes over the groups of ``base`` (g, text, row with train)."""
    weights = np.zeros((shape.rows, CLASSES), np.float32)
    sent = "part int, block int, sums binary, seen binary"
    kinds = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("sums", pa.binary()), ("seen", pa.binary())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, texts = in_order(table)
        trainer = Trainer(given.value, shape)
        own = table.column("row").combine_chunks().field("train").to_pylist()
        _taught(trainer, [t for t, mine in zip(texts, own) if mine], members, shape)
        rows = []
        for c in range(0, shape.rows, _ROWS_A_BLOCK):
            seen = trainer.seen[c : c + _ROWS_A_BLOCK]
            if seen.any():
                rows.append((key[0].as_py(), c // _ROWS_A_BLOCK, (trainer.w[c : c + _ROWS_A_BLOCK] * seen[:, None]).tobytes(), seen.tobytes()))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)] if rows else [pa.array([], f.type) for f in kinds], schema=kinds)

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        out = {n: sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column(n).to_pylist()).astype(np.float32).tobytes() for n in ("sums", "seen")}
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32())} | {n: pa.array([v], pa.binary()) for n, v in out.items()})

    for _ in range(shape.rounds):
        given = base.sparkSession.sparkContext.broadcast(weights)
        parts = base.withColumn("part", F.floor(F.col("g") / _GROUPS_A_TRAINER).cast("int")).groupBy("part").applyInArrow(run, sent)
        some = parts.groupBy("block", F.floor(F.col("part") / 256).alias("many")).applyInArrow(lambda t: add(t.select(["part", "block", "sums", "seen"])), sent)
        new = weights.copy()
        for r in some.groupBy("block").applyInArrow(lambda t: add(t), sent).collect():
            sums, seen = np.frombuffer(r["sums"], np.float32).reshape(-1, CLASSES), np.frombuffer(r["seen"], np.float32)
            at = np.flatnonzero(seen)
            new[r["block"] * _ROWS_A_BLOCK + at] = sums[at] / seen[at, None]
        weights = new
        given.unpersist()
    return weights


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n): how often each token key stands in the texts, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s in slices(texts, 4 * _SLICE):
                keys, n = np.unique(Tokens(texts[s]).keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    return docs.select(F.col(text).cast("binary")).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Counts:
    """Training tokens, distinct ones, and both by group of words that share a member (without the frequent tokens)."""

    tokens: int
    kinds: int
    group_tokens: np.ndarray
    group_kinds: np.ndarray
    alone: tuple[int, ...]


def gathered(counts: DataFrame) -> Counts:
    """Totals of a table of ``token_counts``; GROUPS + ALONE rows at most come to the driver."""
    top = counts.orderBy(F.desc("n"), "key").limit(ALONE).collect()
    alone = tuple(r["key"] % 2**64 for r in top)
    rest = counts.where(~F.col("key").isin([r["key"] for r in top])) if top else counts
    by = {r["k"]: (r["t"], r["d"]) for r in rest.groupBy(F.col("key").bitwiseAND(F.lit(GROUPS - 1)).alias("k")).agg(F.sum("n").alias("t"), F.count("*").alias("d")).collect()}
    tokens, kinds = (np.array([by.get(k, (0, 0))[i] for k in range(GROUPS)], np.int64) for i in (0, 1))
    return Counts(int(tokens.sum()) + sum(r["n"] for r in top), int(kinds.sum()) + len(top), tokens, kinds, alone)


_SENT = "bucket int, g int, n int, keys binary, counts binary"
_REPLY = "bucket int, g int, counts binary"
#: Document groups that one training task learns from.
_GROUPS_A_TRAINER = 4


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's keys, in the order sent."""
    n = table.column("n").to_pylist()
    keys = from_low_bytes(b"".join(table.column("keys").to_pylist()), 8)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
    parts = np.split(total[place], np.cumsum(n)[:-1])
    return pa.table({"bucket": table.column("bucket"), "g": table.column("g"), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})


def word_logs(keys: np.ndarray, counts: np.ndarray, members: np.ndarray, totals: Counts) -> np.ndarray:
    """log10 P(word | member) of each token key with its corpus count."""
    out = np.zeros(len(keys))
    shared = members >= ALONE
    k = members[shared] - ALONE
    out[shared] = np.log10((counts[shared] + 0.1) / (totals.group_tokens + 0.1 * (totals.group_kinds + 1))[k])
    return out


def history_logs(weights: np.ndarray, first: np.ndarray, then: np.ndarray, members: np.ndarray) -> np.ndarray:
    """log10 of P(class | history) P(member | class, history) of each token."""
    out = np.empty(len(members))
    for at in range(0, len(out), 1 << 15):
        s = slice(at, at + (1 << 15))
        m = members[s]
        each = np.arange(len(m))
        out[s] = (log_classes(weights, first[s])[each, m % CLASSES] + log_classes(weights, then[s])[each, m // CLASSES]) / math.log(10)
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape = Shape(), group_bytes: int | None = None, bucket_words: int = 4_000_000) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    The model learns from the rows whose crc32 of the key as text isn't divisible by 10; the
    others are held_out. Tokens: words in lower case (A-Z), then an end. n_known: tokens seen in
    training; train_tokens: training tokens; base_score: sum of log10((c + 0.1) / (N + 0.1 (V + 1)));
    score: log10 of the model's probability of the text.

    Scores don't depend on how the rows are partitioned. A null or empty text is its end token only;
    a very long one is scored whole. A row without a key is a training row; repeated rows count
    each; an empty table gives an empty result. Other columns are not read.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(10)) != 0, F.lit(True)).alias("train"))
    totals = gathered(saved(token_counts(own.where("train"))))
    members = Members(list(totals.alone))
    total = text_bytes(own, "text")
    buckets = max(1, math.ceil(total / 6 / bucket_words))
    base = dealt(own, "text", total, group_bytes or group_size(total, 8 << 20), [F.col("key")])
    kind = base.schema["row"].dataType["key"].dataType.simpleString()
    weights = docs.sparkSession.sparkContext.broadcast(train(base, members, shape))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        table, texts = in_order(table)
        t = Tokens(texts)
        mine = np.array(table.column("row").combine_chunks().field("train").to_pylist(), bool)
        keys, place = np.unique(t.keys, return_inverse=True)
        counts = np.bincount(place, weights=mine[t.doc], minlength=len(keys)).astype(np.uint32)
        rows = [(b, key[0].as_py(), p.stop - p.start, low_bytes(keys[p], 8), counts[p].tobytes()) for b, p in packed(keys, buckets)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(_SENT.split(", "), zip(*rows), kinds)})

    def finish(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        table, texts = in_order(table)
        t = Tokens(texts)
        keys, place = np.unique(t.keys, return_inverse=True)
        answer = dict(zip(replies.column("bucket").to_pylist(), replies.column("counts").to_pylist()))
        counts = np.zeros(len(keys), np.int64)
        for b, p in packed(keys, buckets):
            counts[p] = np.frombuffer(answer[b], np.int64)
        c, docs_n = counts[place], len(t.counts)

        def by_doc(x: np.ndarray) -> np.ndarray:
            return np.bincount(t.doc, weights=x, minlength=docs_n)

        plain = np.log10((c + 0.1) / (totals.tokens + 0.1 * (totals.kinds + 1)))
        inside = word_logs(keys, counts, members.of(keys), totals)[place]
        m = members.of(t.keys)
        first, then = t.rows(shape, m)
        inside += history_logs(weights.value, first, then, m)
        row = table.column("row").combine_chunks()
        return pa.table(
            {
                "key": row.field("key"),
                "held_out": pa.array([not x for x in row.field("train").to_pylist()], pa.bool_()),
                "n_tokens": pa.array(t.counts, pa.int64()),
                "n_known": pa.array(by_doc(c > 0).astype(np.int64), pa.int64()),
                "train_tokens": pa.array([totals.tokens] * docs_n, pa.int64()),
                "base_score": pa.array(by_doc(plain), pa.float64()),
                "score": pa.array(by_doc(inside), pa.float64()),
            }
        )

    groups = base.groupBy("g")
    replies = groups.applyInArrow(send, _SENT).groupBy("bucket").applyInArrow(_answer, _REPLY)
    out = groups.cogroup(replies.groupBy("g")).applyInArrow(finish, f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("key", key)
