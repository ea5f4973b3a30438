"""Removal of repeated passages by fixed-block anchors.

Every ``window``-word passage holds a whole block of ``anchor = (window + 1) // 2`` words that
starts at a multiple of ``anchor`` in its document. These non-overlapping blocks are the
reference index; every rolling window of ``anchor`` words of every document probes it. Where
a probe meets a block at another place, the hit is extended: each ``window``-word passage
around it is compared, by two independent 64-bit hashes of its words, with all other such passages, and
passages found twice or more join to maximal repeated spans, which are removed.

Texts are dealt once into groups of a few MB. What moves after that are packed hashes of a
group's distinct windows and bit masks in reply (see ``_exchange``).
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._exchange import bits, dealt, from_bits, from_low_bytes, give_back, group_size, in_order, low_bytes, packed, runs, text_bytes
from tessera.llm._hashing import Words, slices, window_hashes, window_starts

#: Bytes of a probe hash that are sent; with the bucket they make over 40 bits. Only candidates hang on them.
PROBE_BYTES = 5
_SLICE = 1 << 20
_SENT = "stage int, bucket int, g int, n int, keys binary, many binary, aligned binary"
_REPLY = "stage int, bucket int, g int, found binary"


class _Group:
    """The windows of one group of documents; the same at every pass."""

    def __init__(self, texts: list[bytes | None], window: int) -> None:
        self.window, self.anchor = window, (window + 1) // 2
        self.texts = texts
        parts = [Words(texts[s]) for s in slices(texts, _SLICE)]
        self.words = np.concatenate([p.hashes() for p in parts]) if parts else np.zeros(0, np.uint64)
        self.counts = np.concatenate([p.counts for p in parts]) if parts else np.zeros(0, np.int64)

    def second_lane(self) -> np.ndarray:
        parts = [Words(self.texts[s]).hashes(1) for s in slices(self.texts, _SLICE)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def probes(self) -> None:
        starts, inside = window_starts(self.counts, self.anchor)
        keys = window_hashes(self.words, starts, self.anchor)
        self.keys, self.place, times = np.unique(keys, return_inverse=True, return_counts=True)
        self.many = times > 1
        self.aligned = np.zeros(len(self.keys), bool)
        self.aligned[self.place[inside % self.anchor == 0]] = True

    def candidates(self, hit: np.ndarray) -> None:
        """hit: for each distinct probe, whether it meets a block elsewhere."""
        sums = np.concatenate([[0], np.cumsum(hit[self.place])])
        probes = np.maximum(self.counts - self.anchor + 1, 0)
        starts, inside = window_starts(self.counts, self.window)
        n = np.maximum(self.counts - self.window + 1, 0)
        at = np.repeat(np.cumsum(probes) - probes, n) + inside
        near = sums[at + self.window - self.anchor + 1] > sums[at]
        self.starts = starts[near]
        lanes = (self.words, self.second_lane()) if len(self.starts) else (self.words, self.words)
        a, b = (window_hashes(words, self.starts, self.window, kind) for kind, words in enumerate(lanes))
        order, group, first = runs(a, b)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = group
        self.keys, self.second = a[order][first], b[order][first]
        self.many = np.bincount(group, minlength=len(first)) > 1

    def removed(self, repeated: np.ndarray) -> np.ndarray:
        """Whether each word lies in a repeated passage."""
        starts = self.starts[repeated[self.place]]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def _sent(stage: int, g: int, rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*((stage, b, g, *r) for b, *r in rows))) if rows else [[]] * 7
    return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(_SENT.split(", "), columns, kinds)})


def _replies(table: pa.Table, stage: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    found = np.zeros(len(keys), bool)
    answers = {b: f for s, b, f in zip(*(table.column(c).to_pylist() for c in ("stage", "bucket", "found"))) if s == stage}
    for b, part in packed(keys, buckets):
        if b in answers:
            found[part] = from_bits(answers[b], part.stop - part.start)
    return found


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Which hashes of a bucket stand at two places at least (probes: one of them a block)."""
    n = table.column("n").to_pylist()
    stage, width = table.column("stage")[0].as_py(), PROBE_BYTES if table.column("stage")[0].as_py() == 1 else 16
    data = b"".join(table.column("keys").to_pylist())
    if stage == 1:
        keys = (from_low_bytes(data, width),)
    else:
        both = np.frombuffer(data, "<u8").reshape(-1, 2)
        keys = (both[:, 0], both[:, 1])
    many = np.concatenate([from_bits(m, k) for m, k in zip(table.column("many").to_pylist(), n)])
    order, group, first = runs(*keys)
    size = np.add.reduceat(np.ones(len(order), np.int64) + many[order], first)
    ok = size > 1
    if stage == 1:
        aligned = np.concatenate([from_bits(m, k) for m, k in zip(table.column("aligned").to_pylist(), n)])
        ok &= np.logical_or.reduceat(aligned[order], first)
    found = np.empty(len(order), bool)
    found[order] = ok[group]
    parts = np.split(found, np.cumsum(n)[:-1])
    some = [i for i, p in enumerate(parts) if p.any()]
    picked = table.take(pa.array(some, pa.int64()))
    return pa.table({"stage": picked.column("stage"), "bucket": picked.column("bucket"), "g": picked.column("g"), "found": pa.array([bits(parts[i]) for i in some], pa.binary())})


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    spread: tuple[str, ...] = ("doc_id",),
    window: int = 35,
    group_bytes: int | None = None,
    bucket_words: int = 2_000_000,
    with_text: bool = True,
) -> DataFrame:
    """``docs`` without every word that a repeated passage of ``window`` words covers.

    A passage counts as repeated if its word sequence also starts anywhere else, in the
    same document or another; passages are judged on the input. Words are runs of
    characters other than ASCII white space. Added columns (an input column of such a name
    is replaced): n_words, n_removed (long), kept_sha256 (of the kept words, joined by one
    space). ``text`` becomes the cleaned text: unchanged if nothing was removed, else the kept
    runs as they stood, joined by one space. With ``with_text`` false it is left out.

    A null text stays null and has no words; texts shorter than the window stay whole;
    repeated rows are copies of each other and lose their passages as any copies do; an
    empty table gives an empty result. ``spread`` names columns that, with the text, deal
    rows out evenly; they may hold nulls.
    """
    if window < 1:
        raise ValueError("window is 1 or more")
    total = text_bytes(docs, text)
    buckets = max(1, math.ceil(total / 6 / bucket_words))
    made = ("n_words", "n_removed", "kept_sha256")
    base = dealt(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in made)), text, total, group_bytes or group_size(total, 4 << 20), [F.col(c) for c in spread])

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        group = _Group(in_order(table)[1], window)
        group.probes()
        k = group.keys
        rows = [(b, p.stop - p.start, low_bytes(k[p], PROBE_BYTES), bits(group.many[p]), bits(group.aligned[p])) for b, p in packed(k, buckets)]
        give_back()
        return _sent(1, key[0].as_py(), rows)

    def extend(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(2, 0, [])
        group = _Group(in_order(table)[1], window)
        group.probes()
        group.candidates(_replies(replies, 1, group.keys, buckets))
        both = np.stack([group.keys, group.second], axis=1)
        rows = [(b, p.stop - p.start, both[p].astype("<u8").tobytes(), bits(group.many[p]), b"") for b, p in packed(group.keys, buckets)]
        give_back()
        return _sent(2, key[0].as_py(), rows)

    def finish(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        table, texts = in_order(table)
        group = _Group(texts, window)
        group.probes()
        group.candidates(_replies(replies, 1, group.keys, buckets))
        gone = group.removed(_replies(replies, 2, group.keys, buckets))
        ends = np.cumsum(group.counts)
        n_removed, digests, cleaned = [], [], []
        for t, n, e in zip(texts, group.counts.tolist(), ends.tolist()):
            lost = gone[e - n : e]
            k = int(lost.sum())
            n_removed.append(k)
            words = (t or b"").split()
            digests.append(hashlib.sha256(b" ".join(compress(words, (~lost).tolist()) if k else words)).hexdigest())
            if with_text:
                cleaned.append(_cut(t, lost) if k else t)
        give_back()
        out = {"row": table.column("row")}
        if with_text:
            out["text"] = pa.array(cleaned, pa.binary())
        return pa.table(out | {"n_words": pa.array(group.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    groups = base.groupBy("g")
    near = groups.applyInArrow(probe, _SENT).groupBy("stage", "bucket").applyInArrow(_answer, _REPLY)
    exact = groups.cogroup(near.groupBy("g")).applyInArrow(extend, _SENT).groupBy("stage", "bucket").applyInArrow(_answer, _REPLY)
    schema = T.StructType([T.StructField("row", base.schema["row"].dataType), *T.StructType.fromDDL("text binary, " * with_text + "n_words bigint, n_removed bigint, kept_sha256 string")])
    done = groups.cogroup(near.unionByName(exact).groupBy("g")).applyInArrow(finish, schema)
    kept = [c for c in docs.columns if c not in made and (c != text or with_text)]
    return done.select(*(F.col("text").cast("string").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept), *made)


def _cut(text: bytes, lost: np.ndarray) -> bytes:
    """The runs of kept words as they stand, joined by one space."""
    words = Words([text])
    edge = np.flatnonzero(np.diff(np.concatenate([[True], lost, [True]]).astype(np.int8)))
    return b" ".join(text[words.starts[a] : words.ends[z - 1]] for a, z in zip(edge[0::2], edge[1::2]))
