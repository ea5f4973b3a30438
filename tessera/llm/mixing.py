"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of documents by a hash. A source's target fixes its exact
quota of blocks: so many whole passes over all blocks, plus for the rest the blocks of a fixed
permutation in turn, each that still fits, and a few exchanges that close the gap. A binary
tree over the output shards then splits the vector of quotas: at each node the left half draws
its blocks from the node's by a multivariate hypergeometric law, as a random deal would. At the
leaves each shard holds an exact number of blocks of every source; it draws the next ones of
the permutation, so no two shards share one, and its rows are shuffled locally. The driver
splits the top of the tree only; the subtrees below it are split in tasks.

Everything is keyed by hashes and a seed, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._joins import join_checked
from tessera.llm._storage import saved

WEIGHTS = (5, 2, 1)
LONGEST = 3
#: Blocks of a source at most, and of all sources together: a third of the range of the library's hypergeometric law.
BLOCKS, ALL_BLOCKS = 16_384, 300_000_000
#: Words of a shard; there are LEAST_SHARDS at least.
SHARD_WORDS, LEAST_SHARDS = 32_000_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], most: float = LONGEST) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; none above ``most`` times its size, the excess reshared."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    free = list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def _halves(low: int, high: int, have: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """The middle of a node's shards, and the block counts that its left half draws."""
    middle = (low + high) // 2
    n = int(have.sum()) * (middle - low) // (high - low)
    return middle, np.random.default_rng([seed, low, high]).multivariate_hypergeometric(have, n, method="marginals")


def _split(low: int, high: int, have: np.ndarray, begin: np.ndarray, seed: int, parts: int | None = None) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Nodes (low, high, block counts, blocks before them) below a node of the tree: ``parts`` of them, or the leaves."""
    nodes, done = [(low, high, have, begin)], []
    while nodes and (parts is None or len(nodes) + len(done) < parts):
        low, high, have, begin = nodes.pop(0)
        if high - low == 1:
            done.append((low, high, have, begin))
            continue
        middle, left = _halves(low, high, have, seed)
        nodes += [(low, middle, left, begin), (middle, high, have - left, begin + left)]
    return done + nodes


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts whose columns sum to ``quotas`` exactly; these sum to less than 10**9."""
    have = np.array(quotas, np.int64)
    leaves = _split(0, shards, have, np.zeros_like(have), seed)
    return np.stack([have for _, _, have, _ in sorted(leaves, key=lambda x: x[0])])


def _ranges(spark, quotas: list[int], shards: int, seed: int, cells: int = 4_000_000) -> DataFrame:
    """(sid, shard, begin, end): which of a source's draws each shard gets. The driver holds ``cells`` counts at most."""
    have = np.array(quotas, np.int64)
    top = _split(0, shards, have, np.zeros_like(have), seed, max(1, min(64, cells // max(1, len(quotas))))) if quotas else []
    rows = [(int(low), int(high), own.tolist(), begin.tolist()) for low, high, own, begin in top]

    def below(batches):
        for batch in batches:
            for r in batch.to_pylist():
                for low, _, own, begin in _split(r["low"], r["high"], np.array(r["have"], np.int64), np.array(r["begin"], np.int64), seed):
                    sid = np.flatnonzero(own)
                    yield pa.RecordBatch.from_pydict({"sid": pa.array(sid, pa.int32()), "shard": pa.array([low] * len(sid), pa.int32()), "begin": pa.array(begin[sid], pa.int64()), "end": pa.array((begin + own)[sid], pa.int64())})

    nodes = spark.createDataFrame(rows, "low int, high int, have array<bigint>, begin array<bigint>")
    return nodes.repartition(max(1, len(rows))).mapInArrow(below, "sid int, shard int, begin bigint, end bigint")


def _last_pass(most: float):
    """For the ranked blocks of one source: which ones its last, partial pass takes (``extra``).

    Each block in turn is taken if it fits into what is missing, one that doesn't is passed
    over; so no block is left that fits. Then blocks are added or exchanged, one at a time, as long
    as the target is missed by less.
    """

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        words = table.column("words").to_numpy()
        gap, extra, missed = float(table.column("rest")[0].as_py()), np.zeros(len(words), bool), False
        if table.column("passes")[0].as_py() < most and gap > 0:
            for i, w in enumerate(words.tolist()):
                # blocks without words don't change the gap: those among the leading ones are taken
                if w <= gap and (w or not missed):
                    extra[i], gap = True, gap - w
                else:
                    missed = True
            while gap:
                # the exchange of a taken block (or none) for another that leaves the least gap
                free = np.flatnonzero(~extra)
                free = free[np.argsort(words[free], kind="stable")]
                if not len(free):
                    break
                ours = np.concatenate([[-1], np.flatnonzero(extra)])
                size = np.where(ours < 0, 0, words[ours])
                at = np.searchsorted(words[free], size + gap)
                near = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(free) - 1)])
                off = np.abs(words[free][near] - size - gap)
                side, x = np.unravel_index(off.argmin(), off.shape)
                if off[side, x] >= abs(gap):
                    break
                new = free[near[side, x]]
                gap -= float(words[new] - size[x])
                extra[new] = True
                if ours[x] >= 0:
                    extra[ours[x]] = False
        return table.append_column("extra", pa.array(extra, pa.bool_()))

    return choose


def plan(blocks: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = LONGEST, shards: int | None = None, seed: int = 7):
    """(sources, draws, number of sources) of the block table (source, block, words).

    sources: (source, source_size, target); draws: (source, block, copy, shard), a row for each
    time that a block is drawn. ``shards``: if not given, so many that each has about SHARD_WORDS.
    One row a source comes to the driver; the block table, of BLOCKS rows a source at most,
    doesn't, and the counts by source and shard don't.
    """
    spark = blocks.sparkSession
    totals = blocks.groupBy("source").agg(F.sum("words").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [r["n"] for r in totals]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    whole = [min(int(t // n), math.floor(most)) if n else 0 for t, n in zip(wanted, sizes)]
    rows = [(i, r["source"], n, t, e, t - e * n) for i, (r, n, t, e) in enumerate(zip(totals, sizes, wanted, whole))]
    sources = spark.createDataFrame(rows, "sid int, source string, source_size bigint, target double, passes int, rest double")
    turn = Window.partitionBy("sid").orderBy(F.xxhash64("block", F.lit(seed)), "block")
    ranked = (
        join_checked(blocks, sources, blocks["source"].eqNullSafe(sources["source"]), "inner", len(rows))
        .select("sid", "block", "words", "passes", "rest")
        .withColumn("rank", F.row_number().over(turn))
    )
    ranked = saved(ranked.groupBy("sid").applyInArrow(_last_pass(most), "sid int, block int, words bigint, passes int, rest double, rank int, extra boolean"))
    per = {r["sid"]: r for r in ranked.groupBy("sid").agg(F.count("*").alias("blocks"), F.count_if("extra").alias("extra")).collect()}
    quotas = [whole[i] * per[i]["blocks"] + per[i]["extra"] if i in per else 0 for i in range(len(rows))]
    shards = shards or max(LEAST_SHARDS, math.ceil(sum(sizes) / SHARD_WORDS))
    places = _ranges(spark, quotas, shards, seed).select("sid", "shard", F.explode(F.sequence("begin", F.col("end") - 1)).alias("draw"))
    copies = F.when(F.col("extra"), F.col("passes") + 1).otherwise(F.col("passes"))
    size = Window.partitionBy("sid")
    drawn = (
        ranked.withColumn("n_blocks", F.count("*").over(size))
        .withColumn("turn", F.sum(F.when(F.col("extra"), 1).otherwise(0)).over(turn.rowsBetween(Window.unboundedPreceding, 0)))
        .where(copies > 0)
        .select("sid", "block", "passes", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "rank", "turn", "n_blocks")
        # whole passes take the blocks by rank, the last one takes the extra blocks by their turn
        .withColumn("draw", F.col("copy").cast("bigint") * F.col("n_blocks") + F.when(F.col("copy") < F.col("passes"), F.col("rank")).otherwise(F.col("turn")) - 1)
    )
    return sources, drawn.join(places, ["sid", "draw"]).select("sid", "block", F.col("copy").cast("int").alias("copy"), "shard"), len(rows)


def _keyed(docs: DataFrame, key: str, text: str, source: str, blocks: int, seed: int, with_row: bool = True) -> DataFrame:
    """(row struct of the columns, key, source, size, turn, block); the columns ride in a struct, so their names can't clash.

    turn numbers rows of equal key, text and source from 0, so that they go to different blocks;
    which of them has which number makes no difference.
    """
    sources = docs.select(source).distinct().count()
    blocks = max(1, min(blocks, ALL_BLOCKS // max(1, sources)))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if with_row else []
    name = F.xxhash64(F.col(key), F.col(text), F.col(source))
    own = docs.select(*row, F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), name.alias("h"))
    twins = saved(docs.select(name.alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    if twins.isEmpty():
        own = own.withColumn("turn", F.lit(0).cast("bigint"))
    else:
        # a name that many rows have is numbered partition by partition
        marked = join_checked(own, twins.withColumn("twin", F.lit(True)), "h", "left")
        many = saved(marked.where("twin").drop("twin").withColumn("part", F.spark_partition_id()))
        before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = many.groupBy("h", "part").agg(F.count("*").alias("n")).select("h", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        turns = many.withColumn("at", F.row_number().over(Window.partitionBy("h", "part").orderBy("h")) - 1).join(offsets, ["h", "part"])
        turns = turns.withColumn("turn", (F.col("offset") + F.col("at")).cast("bigint")).drop("part", "at", "offset")
        own = marked.where("twin IS NULL").drop("twin").withColumn("turn", F.lit(0).cast("bigint")).unionByName(turns)
    return own.withColumn("block", F.pmod(F.xxhash64("h", "turn", F.lit(seed)), F.lit(blocks)).cast("int")).drop("h")


def _planned(keyed: DataFrame, weights, most, shards, seed):
    blocks = keyed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    return plan(saved(blocks), weights, most, shards, seed)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = LONGEST, shards: int | None = None, blocks: int = BLOCKS, seed: int = 7) -> DataFrame:
    """The mixed documents: a row for each time that a document is drawn.

    Added columns (an input column of such a name is replaced): copy, shard and position (the place
    of the row in its shard, from 0). Sources take ``weights`` in the order of their code
    points, null last, repeating; see ``taken`` for the amounts and for odd inputs.
    """
    made = ("copy", "shard", "position")
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in made))
    keyed = _keyed(own, key, text, source, blocks, seed)
    sources, draws, n = _planned(keyed, weights, most, shards, seed)
    ids = join_checked(draws, sources.select("sid", F.col("source").alias("of")), "sid", "inner", n)
    ids = saved(ids.select("of", F.col("block").alias("at"), "copy", "shard"))
    rows = join_checked(keyed, ids, keyed["source"].eqNullSafe(ids["of"]) & (keyed["block"] == ids["at"]), "inner")
    local = Window.partitionBy("shard").orderBy(F.xxhash64("key", "copy", "turn", F.lit(seed)), "key", "copy", "turn")
    rows = rows.withColumn("position", F.row_number().over(local) - 1)
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in own.columns), *made)


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = LONGEST, shards: int | None = None, blocks: int = BLOCKS, seed: int = 7) -> DataFrame:
    """(key, size, source_size, target, taken) for each row of ``docs``: what the mix takes of it.

    size: words of the text (null or wordless: 0); target: the source's share of all words
    by weight, at most ``most`` times its size; taken: size times the number of draws, so
    never over ``most`` times size. A source's taken words miss its target by less than a block;
    blocks are single documents in small sources.

    A null source is a source of its own, the last one. Rows without a key are told apart by
    their text; repeated rows are drawn one by one. A source without words has target 0. A very
    long text is one row like any other. An empty table gives an empty result. Other columns are
    not read.
    """
    lean = saved(_keyed(docs, key, text, source, blocks, seed, with_row=False))
    sources, draws, n = _planned(lean, weights, most, shards, seed)
    times = draws.groupBy(F.col("sid").alias("of"), F.col("block").alias("at")).agg(F.count("*").alias("times"))
    known = join_checked(lean, sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")), "inner", n)
    out = known.join(times, (F.col("sid") == F.col("of")) & (F.col("block") == F.col("at")), "left")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).cast("bigint").alias("taken"))
