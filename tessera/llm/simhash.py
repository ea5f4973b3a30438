"""SimHash near-duplicate detection by a segment-popcount embedding.

A fingerprint is cut into segments of ``segment_bits`` bits; its embedding is the vector of
bit counts of the segments. The Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints, so a range join of the embeddings finds every link.
The grid: the coordinates form ``max_distance + 3`` blocks, and two embeddings within
``max_distance`` agree on three blocks at least, so they share the grid cell of one choice
of three blocks. Pairs of a cell pass the Manhattan bound, then the exact comparison.

Sorting the bits inside each segment turns the counts into a thermometer code: its Hamming
distance *is* the Manhattan distance, so embedding, cells and bound are bit operations on one
64-bit number.

A cell's fingerprints are searched breadth first, so it yields fewer links than it has
fingerprints. Those of cells of more than ``cell_limit`` meet at hubs instead: for two
fingerprints within distance 3 there is a value one bit (or none) from the one and two bits
at most from the other. Links through a hub are followed as a star, so work stays linear in
the number of fingerprints, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._exchange import bits, from_bits, give_back, packed
from tessera.llm._graph import components
from tessera.llm._hashing import mix
from tessera.llm._joins import join_checked
from tessera.llm._storage import saved

SEED = 42
#: Independent fingerprints of a text's words; more of them miss fewer near copies.
VIEWS = 8
#: Rows that one task pairs or compares at a time; bytes of hashes that one task counts.
_ROWS_A_BUCKET, _ROWS_A_SALT, _BYTES_A_BUCKET = 100_000, 250, 8 << 20
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACES = 256 * np.arange(8)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have, as a signed number."""
    table = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    ones = (np.bincount((table + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash (as a signed number) of the word shingles of one text; no word: 0."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(joined[s:e], SEED) for s, e in zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp bigint), a row for each row of ``docs``. A null text has fingerprint 0."""
    kind = docs.schema[key].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["key", "fp"])
            give_back()

    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(make, f"key {kind}, fp bigint")


def _blocks(max_distance: int, segment_bits: int) -> list[int]:
    """Masks of the coordinate blocks."""
    segments = np.array_split(np.arange(64 // segment_bits), max_distance + 3)
    one = (1 << segment_bits) - 1
    return [sum(one << (segment_bits * int(s)) for s in block) for block in segments]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def thermometer(fp: F.Column | str, segment_bits: int):
    """Each segment's bits sorted: the bit counts in unary."""
    x = F.col(fp) if isinstance(fp, str) else fp
    if segment_bits == 1:
        return x
    if segment_bits != 2:
        raise ValueError("segment_bits is 1 or 2")
    even = F.lit(0x5555555555555555)
    high, low = F.shiftright(x, 1).bitwiseAND(even), x.bitwiseAND(even)
    return high.bitwiseOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))


def _thermometer(fp: np.ndarray, segment_bits: int) -> np.ndarray:
    """``thermometer`` of unsigned numbers."""
    if segment_bits == 1:
        return fp
    even, one = np.uint64(0x5555555555555555), np.uint64(1)
    high, low = (fp >> one) & even, fp & even
    return high | low | (high & low) << one


def _flips(most: int) -> np.ndarray:
    """Masks of every change of up to ``most`` bits, as (mask, bits changed)."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    out = [(0, 0), *((int(m), 1) for m in one)] if most else [(0, 0)]
    if most > 1:
        out += [(int(one[i] | one[j]), 2) for i, j in combinations(range(64), 2)]
    return np.array([m for m, _ in out], np.uint64), np.array([n for _, n in out], np.uint8)


def hub_links(fps: DataFrame, max_distance: int = 3, buckets: int = 64, batch: int = 512) -> DataFrame:
    """Links (a, b), enough to connect all fingerprints (fp) of ``fps`` within ``max_distance``.

    Each fingerprint visits 1 + 64 + 2016 hubs at most; a hub is met by 2081 at most.
    """
    near, far = max_distance // 2, max_distance - max_distance // 2

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, steps = _flips(far)
        for big in batches:
            for at in range(0, big.num_rows, batch):
                own = big.column(0).slice(at, batch).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                hubs = (own[:, None] ^ masks[None, :]).ravel()
                src = np.repeat(own, len(masks))
                close = np.tile(steps <= near, len(own))
                place = (mix(hubs) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                cuts = np.searchsorted(place[order], np.arange(buckets + 1))
                rows = [(b, order[s:e]) for b, s, e in zip(range(buckets), cuts[:-1], cuts[1:]) if e > s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows], pa.int32()), *(pa.array([a[x].tobytes() for _, x in rows], pa.binary()) for a in (hubs, src, close))],
                    names=["bucket", "hubs", "src", "close"],
                )

    def meet(table: pa.Table) -> pa.Table:
        hubs, src, close = (np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in (("hubs", np.uint64), ("src", np.uint64), ("close", np.bool_)))
        order = np.lexsort((src, ~close, hubs))
        hubs, src, close = hubs[order], src[order], close[order]
        first = np.concatenate([[True], hubs[1:] != hubs[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(hubs)), 0))
        good = close[start] & (src != src[start])
        pairs = np.unique(np.stack([src[good], src[start][good]], axis=1), axis=0).view(np.int64) if good.any() else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return fps.select("fp").mapInArrow(visit, "bucket int, hubs binary, src binary, close binary").groupBy("bucket").applyInArrow(meet, "a bigint, b bigint")


def _forest(cell: np.ndarray, fp: np.ndarray, code: np.ndarray, max_distance: int) -> np.ndarray:
    """Pairs of places within ``max_distance``, enough to connect all such pairs of each cell.

    ``cell`` is sorted. Each fingerprint is found once, so a cell of n gives n - 1 pairs at most.
    """

    def near(a, b) -> np.ndarray:
        """The places of ``b`` within the Manhattan bound of ``a`` that pass the exact comparison."""
        out = np.bitwise_count(code[a] ^ code[b]) <= max_distance
        out[out] = (np.bitwise_count(fp[a] ^ fp[b]) <= max_distance)[out]
        return out

    cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    sizes = np.diff(cuts)
    two = cuts[:-1][sizes == 2]
    two = two[near(two, two + 1)]
    out = [np.stack([two, two + 1], axis=1)]
    for start, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        left, queue = np.arange(start, start + n), []
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
            at = queue.pop()
            hit = near(at, left)
            if hit.any():
                found, left = left[hit], left[~hit]
                queue += found.tolist()
                out.append(np.stack([np.full(len(found), at), found], axis=1))
    return np.concatenate(out)


def links(fps: DataFrame, max_distance: int = 3, segment_bits: int = 2, cell_limit: int = 4096) -> DataFrame:
    """Links (view, a, b) between distinct fingerprints (view, fp) of a view that connect all within ``max_distance``.

    A cell gives links that connect its fingerprints, fewer than it has; so links grow with the number
    of fingerprints, not of pairs. Cells beyond the limit are linked through hubs.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("max_distance is 0 to 3")
    masks = [_signed(sum(c)) for c in combinations(_blocks(max_distance, segment_bits), 3)]
    coded = fps.select("view", "fp", thermometer("fp", segment_bits).alias("code"))
    # view, choice and cell in one number: cells that happen to share it are compared as one
    cells = coded.select("view", "fp", F.explode(F.array(*(F.xxhash64("view", F.lit(i), F.col("code").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))).alias("cell"))
    sizes = saved(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    rows, hot_cells = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") <= cell_limit, F.col("n"))), F.lit(0)), F.count_if(F.col("n") > cell_limit)).first()
    full = saved(join_checked(cells, sizes, "cell", "inner").select("cell", "n", "view", "fp"))
    buckets = max(1, -(-rows // _ROWS_A_BUCKET))

    def pair(table: pa.Table) -> pa.Table:
        cell, view, fp = (table.column(n).to_numpy() for n in ("cell", "view", "fp"))
        order = np.lexsort((fp, view, cell))
        cell, view, fp = cell[order], view[order], fp[order]
        own = np.cumsum(np.concatenate([[False], (cell[1:] != cell[:-1]) | (view[1:] != view[:-1])]))
        bits = fp.view(np.uint64)
        a, b = _forest(own, bits, _thermometer(bits, segment_bits), max_distance).T
        give_back()
        return pa.table({"view": pa.array(view[a], pa.int32()), "a": pa.array(np.minimum(fp[a], fp[b]), pa.int64()), "b": pa.array(np.maximum(fp[a], fp[b]), pa.int64())})

    cold = full.where(F.col("n") <= cell_limit).select(F.pmod(F.xxhash64("cell", F.lit(1)), F.lit(buckets)).cast("int").alias("bucket"), "cell", "view", "fp")
    pairs = cold.groupBy("bucket").applyInArrow(lambda t: pair(t), "view int, a bigint, b bigint")
    if hot_cells:
        hot = saved(full.where(F.col("n") > cell_limit).select("view", "fp").distinct())
        for r in hot.groupBy("view").count().collect():
            found = hub_links(hot.where(F.col("view") == r["view"]), max_distance, max(16, r["count"] // 500))
            pairs = pairs.unionByName(found.select(F.lit(r["view"]).alias("view"), "a", "b"))
    return pairs.distinct()


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    max_distance: int = 3,
    segment_bits: int = 2,
    cell_limit: int = 4096,
) -> DataFrame:
    """(key, fingerprint, component_id) for each row of ``docs``.

    fingerprint: 16 hex digits; component_id: the smallest key reachable over links of at
    most ``max_distance`` differing bits, itself included.

    Null or wordless texts have fingerprint zero and link like any other; repeated rows
    share a fingerprint and so a component; null keys count for no minimum (a component
    of null keys only has a null component_id); an empty table gives an empty result.
    Other columns of ``docs`` are not read.
    """
    marked = saved(fingerprints(docs, key, text, shingle))
    classes = saved(marked.groupBy("fp").agg(F.min("key").alias("least")))
    near = links(classes.select(F.lit(0).alias("view"), "fp"), max_distance, segment_bits, cell_limit)
    roots = saved(components(near.select("a", "b")))
    linked = roots.join(classes, roots["node"] == classes["fp"])
    least = linked.groupBy("root").agg(F.min("least").alias("least"))
    of_linked = roots.join(least, "root").select(F.col("node").alias("fp"), F.col("least").alias("linked"))
    # written, so that the join below reads both sides as they are dealt out and Spark can split a fingerprint that many rows share
    owner = saved(classes.join(of_linked, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id")))
    return marked.join(owner, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", views: int = VIEWS) -> DataFrame:
    """(key, mark, digest, fps) for each row: SimHashes of the text's distinct words by ``views`` independent hashes.

    mark is a hash of the text as it stands, digest one of 128 bits of its words in order. A text
    without a word has neither digest nor fps.
    """
    import xxhash

    kind = docs.schema[key].dataType.simpleString()
    turns = [np.uint64((v * 0x9E3779B97F4A7C15) % 2**64) for v in range(views)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fps = [], []
            for t in batch.column(2):
                words = _words(t.as_py())
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                own = set(words)
                hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in own), np.uint64, len(own))
                fps.append([majority(mix(hashes + turn)) for turn in turns] if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(fps, pa.list_(pa.int64()))], names=["key", "mark", "digest", "fps"])
            give_back()

    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text")).mapInArrow(make, f"key {kind}, mark bigint, digest binary, fps array<bigint>")


def shingle_hashes(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (shorter texts: the whole sequence)."""
    import xxhash

    w = _words(text)
    found = {xxhash.xxh3_64_intdigest(b" ".join(w[i : i + shingle])) for i in range(max(1, len(w) - shingle + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def jaccard(a: bytes | None, b: bytes | None, shingle: int = 5) -> float:
    """Similarity of the sets of word shingles of two texts (shorter texts: the whole sequence); two empty ones: 1."""
    return _alike(shingle_hashes(a, shingle), shingle_hashes(b, shingle))


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _close(a: np.ndarray, others: list[np.ndarray], similarity: float) -> list[int]:
    """Places of the ``others`` that have ``similarity`` or more with ``a``."""
    n = len(a)
    return [i for i, b in enumerate(others) if min(n, len(b)) >= similarity * max(n, len(b)) - 1e-9 and _alike(a, b) >= similarity]


def _in_both(a: list[np.ndarray], b: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many hashes each set of ``a`` has in common with each of ``b``, by products of 0/1 matrices over the hashes that both sides have."""
    keys, rows = zip(*((np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (a, b)))
    words = np.intersect1d(*keys)
    ends = []
    for k, row in zip(keys, rows):
        at = np.minimum(np.searchsorted(words, k), max(0, len(words) - 1))
        known = words[at] == k if len(words) else np.zeros(len(k), bool)
        at, row = at[known], row[known]
        order = np.argsort(at, kind="stable")
        ends.append((at[order], row[order]))
    out = np.zeros((len(a), len(b)))
    for start in range(0, len(words), step):
        parts = []
        for (at, row), side in zip(ends, (a, b)):
            part = np.zeros((len(side), min(step, len(words) - start)), np.float32)
            s, e = np.searchsorted(at, [start, start + step])
            part[row[s:e], at[s:e] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _owned(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the owner of each; 0: several, or one of them is 0."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    first, last = owners[cuts[:-1]], owners[cuts[1:] - 1]
    return keys[cuts[:-1]], np.where(first == last, first, np.uint64(0))


def _links_between(parts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the parts (group, salt, node, root) of a group wherever two nodes of different parts have ``similarity`` or more.

    ``sets`` (group, node, salt, set) are the nodes' shingle hashes. A node with such a link has at least
    that share of its hashes in other parts of its group: hashes are counted by packets, one for
    each chunk and bucket, and the other nodes go. Of those that remain, all outside a group's largest part are
    compared with all in other parts, in blocks; a block yields fewer links than it has parts.
    """

    def arrays(table: pa.Table) -> tuple[list[bytes], list[np.ndarray]]:
        return table.column("node").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]

    def offer(key: tuple, own: pa.Table, table: pa.Table) -> pa.Table:
        """A chunk's distinct hashes, each with the part that has it, packed for the buckets."""
        rows = []
        if own.num_rows:
            owner = dict(zip(own.column("node").to_pylist(), own.column("owner").to_pylist()))
            nodes, found = arrays(table)
            owners = np.repeat(np.array([owner[n] for n in nodes], np.int64).view(np.uint64), [len(x) for x in found])
            hashes, owners = _owned(np.concatenate(found), owners)
            rows = [(b, hashes[s].tobytes(), owners[s].tobytes()) for b, s in packed(hashes, own.column("buckets")[0].as_py())]
        n = len(rows)
        out = [pa.array([key[0].as_py()] * n, pa.binary()), pa.array([key[1].as_py()] * n, pa.int32()), pa.array([r[0] for r in rows], pa.int32())]
        give_back()
        return pa.table([*out, *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["group", "salt", "bucket", "hashes", "owners"])

    def answer(table: pa.Table) -> pa.Table:
        """For each packet, which of its hashes several parts have."""
        hashes, owners = ([np.frombuffer(x, np.uint64) for x in table.column(n).to_pylist()] for n in ("hashes", "owners"))
        known, owner = _owned(np.concatenate(hashes), np.concatenate(owners))
        flags = [bits(owner[np.searchsorted(known, x)] == 0) for x in hashes]
        return table.select(["group", "salt", "bucket"]).append_column("n", pa.array(map(len, hashes), pa.int64())).append_column("flags", pa.array(flags, pa.binary()))

    def pick(key: tuple, told: pa.Table, table: pa.Table) -> pa.Table:
        """The nodes of a chunk with enough hashes that several parts have."""
        if not told.num_rows:
            return pa.table({"node": pa.array([], pa.binary())})
        nodes, found = arrays(table)
        told, hashes = told.sort_by("bucket"), np.unique(np.concatenate(found))
        several = np.concatenate([from_bits(f, n) for f, n in zip(told.column("flags").to_pylist(), told.column("n").to_pylist())])
        kept = [n for n, x in zip(nodes, found) if several[np.searchsorted(hashes, x)].sum() >= similarity * len(x) - 1e-9]
        give_back()
        return pa.table({"node": pa.array(kept, pa.binary())})

    def join(key: tuple, some: pa.Table, others: pa.Table) -> pa.Table:
        """Links between the parts of a block, found so that each joins two that no earlier one has joined."""
        links: list[tuple[bytes, bytes]] = []
        if some.num_rows and others.num_rows:
            (nodes, a), (them, b) = arrays(some), arrays(others)
            mine, theirs = some.column("root").to_pylist(), others.column("root").to_pylist()
            both = _in_both(a, b)
            close = both / (np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - both) >= similarity
            to: dict[bytes, bytes] = {}

            def top(x: bytes) -> bytes:
                while (up := to.get(x, x)) != x:
                    to[x] = x = to.get(up, up)
                return x

            for i, k in np.argwhere(close).tolist():
                x, y = top(mine[i]), top(theirs[k])
                if x != y:
                    to[x] = y
                    links.append((nodes[i], them[k]))
        give_back()
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    broken = parts.groupBy("group").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    weights = sets.groupBy("group").agg(F.ceil(F.sum(F.octet_length("set")) / _BYTES_A_BUCKET).cast("int").alias("buckets"))
    own = parts.join(broken.join(weights, "group").select("group", "buckets"), "group").select("group", "salt", "node", F.xxhash64("root").alias("owner"), "buckets")
    chunks = sets.groupBy("group", "salt")
    offered = own.groupBy("group", "salt").cogroup(chunks).applyInArrow(offer, "group binary, salt int, bucket int, hashes binary, owners binary")
    told = offered.groupBy("group", "bucket").applyInArrow(lambda t: answer(t), "group binary, salt int, bucket int, n bigint, flags binary")
    picked = saved(told.groupBy("group", "salt").cogroup(chunks).applyInArrow(pick, "node binary"))
    left = saved(parts.join(picked, "node", "left_semi").select("group", "node", "root"))
    counts = left.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    counts = counts.where("n > most.n").select("group", F.col("most.root").alias("largest"), *(F.ceil(x / _ROWS_A_SALT).cast("int").alias(name) for x, name in ((F.col("n") - F.col("most.n"), "xs"), (F.col("n"), "ys"))))
    rows = sets.select("group", "node", "set").join(left.join(counts, "group").drop("group"), "node")
    rows = saved(rows.withColumn("x", F.pmod(F.xxhash64("node", F.lit(1)), "xs").cast("int")).withColumn("y", F.pmod(F.xxhash64("node", F.lit(2)), "ys").cast("int")))
    some = rows.where("root <> largest").select("group", "x", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), "node", "root", "set")
    others = rows.select("group", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), "y", "node", "root", "set")
    return some.groupBy("group", "x", "y").cogroup(others.groupBy("group", "x", "y")).applyInArrow(join, "a binary, b binary")


def verified_links(members: DataFrame, edges: DataFrame, texts: DataFrame, similarity: float = 0.8, shingle: int = 5, whole: int = 64, heads: int = 16) -> DataFrame:
    """Links (a, b) between the nodes of ``members`` (group, node), enough to connect all of a group whose ``texts`` (node, text) have ``similarity`` or more.

    ``edges`` (a, b) are candidates within the groups. In a group of at most ``whole`` nodes all are
    compared, in one task. In a larger one all edges are verified; then ``heads`` nodes are compared with
    all of the group, those with the most links, and after that as many of those that no such head has a
    link to. That joins copies that gather around an original; whatever it leaves apart is compared
    by ``_links_between``, so no two nodes with a link stay apart. Each link returned has the similarity.
    """
    made = "group binary, node binary, salt int, set binary"
    links_made = "a binary, b binary"
    sizes = members.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    sized = saved(members.join(sizes, "group").select("group", "node", "n", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / _ROWS_A_SALT)).cast("int").alias("salt")))
    rows = texts.join(sized, "node").select("group", "node", "n", "salt", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([shingle_hashes(t.as_py(), shingle).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("node"), batch.column("salt"), own], names=["group", "node", "salt", "set"])
            give_back()

    def arrays(table: pa.Table) -> tuple[list[bytes], list[np.ndarray]]:
        return table.column("node").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]

    def pairs(found: list[tuple[bytes, bytes]]) -> pa.Table:
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    def compare_all(table: pa.Table) -> pa.Table:
        nodes, own = arrays(table.sort_by("node"))
        return pairs([(nodes[i], nodes[i + 1 + k]) for i in range(len(nodes)) for k in _close(own[i], own[i + 1 :], similarity)])

    def compare_sent(key: tuple, sent: pa.Table, table: pa.Table) -> pa.Table:
        """What was sent (with partners: only with these) against a chunk of its group."""
        (first, theirs), (nodes, own), partners = arrays(sent), arrays(table), sent.column("partners").to_pylist()
        at, found = {n: i for i, n in enumerate(nodes)}, []
        for node, mine, some in zip(first, theirs, partners):
            places = range(len(nodes)) if some is None else [at[x] for x in some]
            found += [(node, nodes[places[k]]) for k in _close(mine, [own[i] for i in places], similarity) if nodes[places[k]] != node]
        return pairs(found)

    found = saved(rows.where(F.col("n") <= whole).mapInArrow(sets, made).groupBy("group").applyInArrow(lambda t: compare_all(t), links_made))
    large = sized.where(F.col("n") > whole).select("group", "node", "salt")
    if large.isEmpty():
        return found
    many = saved(rows.where(F.col("n") > whole).mapInArrow(sets, made))
    chunks = large.select("group", "salt").distinct()

    def compared(sent: DataFrame) -> DataFrame:
        """sent: (group, salt, node, partners)"""
        sent = sent.join(many.select("node", "set"), "node")
        sent = sent.select(F.col("group").alias("of"), F.col("salt").alias("part"), F.col("node").alias("node"), F.col("set").alias("set"), "partners")
        return sent.groupBy("of", "part").cogroup(many.groupBy("group", "salt")).applyInArrow(compare_sent, links_made)

    wanted = edges.join(large.withColumnRenamed("node", "a"), "a").groupBy("group", "salt", F.col("b").alias("node")).agg(F.collect_set("a").alias("partners"))
    mine, tried = saved(compared(wanted)), large.select("node").limit(0)
    for _ in range(2):
        ends = mine.select("a", "b").unionByName(mine.select(F.col("b").alias("a"), F.col("a").alias("b")))
        taken = ends.join(tried.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")).unionByName(tried).distinct()
        free = ends.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links")).join(taken, "node", "left_anti")
        turn = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("links"), "node"))
        chosen = saved(large.join(free, "node").withColumn("turn", turn).where(F.col("turn") <= heads).select("group", "node"))
        new = compared(chosen.join(chunks, "group").withColumn("partners", F.lit(None).cast("array<binary>")))
        mine, tried = saved(mine.unionByName(new).distinct()), chosen.select("node")
    apart = saved(large.join(components(mine), "node", "left").select("group", "salt", "node", F.coalesce("root", "node").alias("root")))
    return found.unionByName(mine).unionByName(_links_between(apart, many, similarity))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", views: int = VIEWS, similarity: float = 0.8, shingle: int = 5, **how) -> DataFrame:
    """(key, mark, kept) for each row of ``docs`` with a key and a word: ``kept`` is the smallest key of its group.

    Groups are the components over links of ``similarity`` or more between the word shingles of two
    texts, and over equal word sequences. Links are looked for among the texts that the word
    fingerprints connect, in any view (see ``links``), and verified exactly (see ``verified_links``).
    mark: a hash of the text; with the key it names the row.
    """
    own = docs.where(F.col(key).isNotNull())
    marked = saved(word_fingerprints(own, key, text, views).where("digest IS NOT NULL"))
    texts = saved(marked.groupBy("digest").agg(F.min(F.struct("key", "mark")).alias("first"), F.min("fps").alias("fps")))
    seen = texts.select("digest", F.posexplode("fps").alias("view", "fp"))
    classes = saved(seen.groupBy("view", "fp").agg(F.min("digest").alias("least"), F.count("*").alias("n")))
    near = links(classes.select("view", "fp"), **how)
    ends = near.join(classes.select("view", F.col("fp").alias("a"), F.col("least").alias("x")), ["view", "a"]).join(classes.select("view", F.col("fp").alias("b"), F.col("least").alias("y")), ["view", "b"])
    shared = saved(classes.where("n > 1").select("view", "fp", "least"))
    same = seen.join(shared, ["view", "fp"]).where("digest <> least").select(F.col("digest").alias("a"), F.col("least").alias("b"))
    edges = saved(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same).distinct())
    roots = saved(components(edges))
    named = saved(texts.join(roots, texts["digest"] == roots["node"]).select("digest", "first.*", F.col("root").alias("group"), "node"))
    members = named.select("group", "node")
    wanted = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    wanted = join_checked(wanted, named.select("key", "mark", "digest"), ["key", "mark"], "inner").select(F.col("digest").alias("node"), "text").dropDuplicates(["node"])
    linked = saved(components(verified_links(members, edges, wanted, similarity, shingle)))
    least = linked.join(texts, linked["node"] == texts["digest"]).groupBy("root").agg(F.min("first.key").alias("kept"))
    of_linked = linked.join(least, "root").select(F.col("node").alias("digest"), "kept")
    owner = saved(texts.join(of_linked, "digest", "left").select("digest", F.coalesce("kept", "first.key").alias("kept")))
    return marked.join(owner, "digest").select("key", "mark", "kept")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", views: int = VIEWS, similarity: float = 0.8, **how) -> DataFrame:
    """``docs`` without the near duplicates: of each group (see ``groups``) the row with the smallest key stays.

    Rows without a key can't be told apart and stay, as do null and wordless texts; repeated
    rows of a kept key stay; ties can't be, the smallest key is one key; very long texts are compared
    whole; an empty table gives an empty result. All columns are returned unchanged, whatever their names.
    """
    dropped = saved(groups(docs, key, text, views, similarity, **how).where("key > kept").select(F.col("key").alias("_key"), F.col("mark").alias("_mark")).distinct())
    return join_checked(docs, dropped, (dropped["_key"] == docs[key]) & (dropped["_mark"] == F.xxhash64(docs[text])), "left_anti")
