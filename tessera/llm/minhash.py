"""MinHash near-duplicate detection with SuperMinHash signatures.

Each element of a set draws a random permutation of the signature's places, by Fisher-Yates, one
step at a time; in step j the place it meets is offered the rank j plus a random fraction, and a
place keeps its smallest offer. All elements take step j together, and a document is done as soon
as all its places hold a rank of at most j, as no later step can offer less: the steps are about
places * ln(places) / elements. A place of two sets is equal with the probability of their Jaccard
similarity; the ranks of one element are all different, so the estimate varies less than with
independent hashes.

Signatures are cut into bands; sets that agree on a band share a cell. In a cell, pairs whose
signatures rule out the similarity are passed over (by far: see ``_enough``), the others are
linked as a forest. The candidates' components are verified exactly on full sets, and the verified
links' components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._exchange import give_back
from tessera.llm._graph import components
from tessera.llm._hashing import U64, Words, mix, slices, window_hashes, window_starts
from tessera.llm._joins import join_checked
from tessera.llm._storage import saved
from tessera.llm.simhash import verified_links

#: 48 bands of 6 places: two sets with a similarity of 0.8 share no cell with a probability under 1e-6, of 0.1 one with 5e-5.
BANDS, ROWS = 48, 6
#: Places whose low bytes a cell compares.
SKETCH = 128
_STEP, _RANK = 0x9E3779B97F4A7C15, U64(54)
#: Elements whose permutations a task holds at a time; bytes of text that it makes signatures of together; rows that one task pairs.
_ELEMENTS, _BYTES, _ROWS_A_BUCKET = 1 << 14, 1 << 17, 100_000


def shingle_sets(blobs: list[bytes | None], shingle: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct word shingle, sorted; a text of fewer words has one, the whole sequence."""
    words = Words(blobs, lower=True)
    hashes = words.hashes()
    starts, _ = window_starts(words.counts, shingle)
    texts = [np.repeat(np.arange(len(blobs)), np.maximum(words.counts - shingle + 1, 0))]
    found = [window_hashes(hashes, starts, shingle)]
    for n in range(1, shingle):
        short = np.flatnonzero(words.counts == n)
        texts.append(short)
        found.append(window_hashes(hashes, words.first[short], n))
    text, own = np.concatenate(texts), np.concatenate(found)
    order = np.lexsort((own, text))
    text, own = text[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (text[1:] != text[:-1]) | (own[1:] != own[:-1])
    return text[new], own[new]


def super_minhash(sets: np.ndarray, elements: np.ndarray, n: int, places: int) -> np.ndarray:
    """The signatures, n x places, of ``n`` sets: element i (a 64-bit hash) is in set ``sets[i]``; a set without elements keeps the highest value."""
    out = np.full((n, places), np.iinfo(np.uint64).max, U64)
    flat, start = out.ravel(), np.arange(places, dtype=np.uint16)
    for begin in range(0, len(elements), _ELEMENTS):
        own, seed = sets[begin : begin + _ELEMENTS], elements[begin : begin + _ELEMENTS]
        order = np.broadcast_to(start, (len(own), places)).copy()
        alive = np.arange(len(own))
        for j in range(places):
            top = np.full(n, 0, U64)
            here = np.unique(own[alive])
            top[here] = out[here].max(axis=1)
            alive = alive[(top[own[alive]] >> _RANK) >= j]
            if not len(alive):
                break
            x = seed[alive]
            fraction = mix(x + U64((2 * j + 1) * _STEP % 2**64)) >> U64(10)
            swap = j + ((mix(x + U64((2 * j + 2) * _STEP % 2**64)) >> U64(32)) * U64(places - j) >> U64(32)).astype(np.int64)
            place = order[alive, swap]
            order[alive, swap] = order[alive, j]
            np.minimum.at(flat, own[alive] * places + place, (U64(j) << _RANK) | fraction)
    return out


def _bands(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band, n x bands; equal bands of different places differ."""
    parts = signatures.reshape(len(signatures), bands, -1)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64) * U64(_STEP)), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        out = mix(out * U64(_STEP) + parts[:, :, i])
    return out.view(np.int64)


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, mark, n_shingles, digest, cells, sketch) for each row.

    mark is a hash of the text as it stands, digest one of 128 bits of its set, cells the bands' hashes and sketch the
    low bytes of the first places. A text without a word has none of the last three.
    """
    kind = docs.schema[key].dataType.simpleString()
    places = bands * rows
    if places > 1023:
        raise ValueError("a signature has 1023 places at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(2).to_pylist()
            for part in slices(blobs, _BYTES):
                own, n = blobs[part], part.stop - part.start
                sets, elements = shingle_sets(own, shingle)
                cuts = np.searchsorted(sets, np.arange(n + 1))
                counts = np.diff(cuts)
                signatures = super_minhash(sets, elements, n, places)
                cells, sketch = _bands(signatures, bands), signatures[:, :SKETCH].astype(np.uint8)
                full = [bool(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, n),
                        batch.column(1).slice(part.start, n),
                        pa.array(counts, pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(elements[s:e].tobytes()) if e > s else None for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()),
                        pa.array([c if f else None for c, f in zip(cells, full)], pa.list_(pa.int64())),
                        pa.array([s.tobytes() if f else None for s, f in zip(sketch, full)], pa.binary()),
                    ],
                    names=["key", "mark", "n_shingles", "digest", "cells", "sketch"],
                )
            give_back()

    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"key {kind}, mark bigint, n_shingles bigint, digest binary, cells array<bigint>, sketch binary")


def _enough(similarity: float) -> int:
    """Equal bytes that two sketches of sets with ``similarity`` have but for a chance of some 1e-8: the mean less 5.5 deviations."""
    return int(SKETCH * similarity - 5.5 * (SKETCH * similarity * (1 - similarity)) ** 0.5)


def _forest(cell: np.ndarray, sketch: np.ndarray, need: int) -> np.ndarray:
    """Pairs of places, enough to connect all pairs of a cell with ``need`` equal bytes; ``cell`` is sorted. Fewer pairs than places."""
    cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    sizes = np.diff(cuts)
    two = cuts[:-1][sizes == 2]
    two = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= need]
    out = [np.stack([two, two + 1], axis=1)]
    for start, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        left, queue = np.arange(start, start + n), []
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
            at = queue.pop()
            hit = (sketch[at] == sketch[left]).sum(axis=1) >= need
            if hit.any():
                found, left = left[hit], left[~hit]
                queue += found.tolist()
                out.append(np.stack([np.full(len(found), at), found], axis=1))
    return np.concatenate(out)


def candidates(sets: DataFrame, similarity: float = 0.8, cell_limit: int = 4096) -> DataFrame:
    """Edges (a, b) that connect the sets (digest, cells, sketch) that share a cell and whose sketches allow ``similarity``.

    A cell yields fewer edges than it has sets. In cells beyond the limit sketches aren't compared: all are
    connected with the smallest, so nothing is lost there either.
    """
    cells = sets.select("digest", F.explode("cells").alias("cell"))
    sizes = saved(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("digest").alias("least")).where("n > 1"))
    rows, hot = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") <= cell_limit, F.col("n"))), F.lit(0)), F.count_if(F.col("n") > cell_limit)).first()
    met = saved(join_checked(cells, sizes.select("cell", "n"), "cell", "inner"))
    buckets, need = max(1, -(-rows // _ROWS_A_BUCKET)), _enough(similarity)

    def pair(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("digest", "ascending")]).combine_chunks()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        a, b = _forest(table.column("cell").to_numpy(), sketch, need).T
        nodes = table.column("digest")
        give_back()
        return pa.table({"a": nodes.take(pa.array(a)), "b": nodes.take(pa.array(b))})

    cold = met.where(F.col("n") <= cell_limit).select("digest", "cell").join(sets.select("digest", "sketch"), "digest")
    cold = cold.select(F.pmod(F.xxhash64("cell", F.lit(1)), F.lit(buckets)).cast("int").alias("bucket"), "cell", "digest", "sketch")
    edges = cold.groupBy("bucket").applyInArrow(lambda t: pair(t), "a binary, b binary")
    if hot:
        large = join_checked(met.where(F.col("n") > cell_limit), sizes.where(F.col("n") > cell_limit).select("cell", "least"), "cell", "inner", hot)
        edges = edges.unionByName(large.where("digest <> least").select(F.col("least").alias("a"), F.col("digest").alias("b")))
    return edges.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 2, bands: int = BANDS, rows: int = ROWS, cell_limit: int = 4096) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    Two texts are linked if the sets of their word shingles (A-Z lower-cased; fewer words: the whole
    sequence) have a Jaccard similarity of at least ``similarity``; shingles are compared by 64-bit hashes.
    component_id is the smallest key reachable, itself included, and kept says whether it is the row's own.

    A null, empty or wordless text has no shingle and is linked with nothing. Rows of equal sets are
    one set from the start, so copies cost no pairs; repeated rows of a kept key are all kept; a tie at
    exactly ``similarity`` is a link. Rows without a key can't be told apart: they link with nothing, have no component
    and are kept. Very long texts are taken whole; an empty table gives an empty result; other columns of
    ``docs`` aren't read, whatever their names.
    """
    own = saved(marked(docs, key, text, shingle, bands, rows))
    known = own.where("digest IS NOT NULL AND key IS NOT NULL")
    sets = saved(known.groupBy("digest").agg(F.min(F.struct("key", "mark")).alias("first"), F.min("cells").alias("cells"), F.min("sketch").alias("sketch")))
    edges = saved(candidates(sets, similarity, cell_limit))
    named = saved(sets.join(components(edges), F.col("digest") == F.col("node")).select("digest", "first.*", F.col("root").alias("group")))
    wanted = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    wanted = join_checked(wanted, named.select("key", "mark", "digest"), ["key", "mark"], "inner").select(F.col("digest").alias("node"), "text").dropDuplicates(["node"])
    linked = saved(components(verified_links(named.select("group", F.col("digest").alias("node")), edges, wanted, similarity, shingle)))
    least = linked.join(sets, F.col("node") == F.col("digest")).groupBy("root").agg(F.min("first.key").alias("least"))
    of_linked = linked.join(least, "root").select(F.col("node").alias("digest"), "least")
    # written, so that Spark can split a set that many rows share
    owner = saved(sets.join(of_linked, "digest", "left").select("digest", F.coalesce("least", "first.key").alias("component_id")))
    found = known.join(owner, "digest").select("key", "n_shingles", "component_id")
    rest = own.where("digest IS NULL OR key IS NULL").select("key", "n_shingles", F.col("key").alias("component_id"))
    return found.unionByName(rest).select(F.col("key").alias(key), "n_shingles", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))
