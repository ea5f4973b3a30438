"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over ``SPAN`` consecutive words: the words at its ignored places may
differ. Every window of every document is hashed under each mask and joined with the hashes
of all windows of the benchmark; two substituted words stay unseen by the mask that ignores
their places, whatever their distance within the window. A hit names a diagonal of a text and
an item; once for each diagonal both are compared word by word, along the whole item: matches count 1,
substitutions cost 2, and the best stretch (ungapped local alignment) must reach ``least``
points, or the item's length if that is less.

Before hashing, windows with two selected neighbours that no benchmark item has side by side are
passed over; no such window can match. What is joined are bare seeds; words are fetched for hits only. All of
it is built-in Spark expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._joins import BROADCAST_ROWS, join_checked
from tessera.llm._storage import saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: 1: the word counts, 0: it may differ. Two places at each distance from 1 to 7.
MASKS = ("11100111", "11010111", "11011011", "10111011", "10111101", "01111101", "01111110")
SPAN = len(MASKS[0])
#: Distinct pairs of neighbours in the benchmark up to which windows are passed over by a literal set; beyond it all windows are joined.
PAIRS = 20_000


def words_of(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits (all characters beyond ASCII count as letters)."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(WORD), F.lit(0))


def _places(mask: str) -> list[int]:
    return [i for i, x in enumerate(mask) if x == "1"]


def _sides(m: int) -> list[int]:
    """Places of a mask that are selected together with the next one."""
    return [i for i in range(SPAN - 1) if MASKS[m][i : i + 2] == "11"]


def _key(words: str, at: Column, m: int) -> Column:
    return F.xxhash64(F.lit(m), *(F.get(words, at + o) for o in _places(MASKS[m])))


def _seeds(frame: DataFrame, words: str, usable) -> DataFrame:
    """A row (seed, at) for each mask and window of ``frame``; usable(at, mask number): a filter."""
    last = F.size(words) - SPAN

    def under(m: int) -> Column:
        places = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)), lambda i: usable(i, m))
        return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.struct(_key(words, i, m).alias("seed"), i.alias("at")))

    found = F.concat(*map(under, range(len(MASKS))))
    return frame.select("*", F.explode(found).alias("s")).select("*", "s.seed", "s.at").drop("s")


def _best(hit: str) -> Column:
    """(score, matches) of the best stretch of the boolean array ``hit``."""
    zero = F.struct(F.lit(0).alias("score"), F.lit(0).alias("matches"), F.lit(0).alias("cur"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        cur = s["cur"] + F.when(x, 1).otherwise(-2)
        n = s["n"] + F.when(x, 1).otherwise(0)
        up = cur > s["score"]
        return F.struct(F.when(up, cur).otherwise(s["score"]).alias("score"), F.when(up, n).otherwise(s["matches"]).alias("matches"), F.greatest(cur, F.lit(0)).alias("cur"), F.when(cur > 0, n).otherwise(0).alias("n"))

    return F.aggregate(hit, zero, step)


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 10) -> DataFrame:
    """(key, mark, item, score, matches): the best overlap of each document and benchmark item.

    mark is a hash of the document's text; with the key it names the row.
    """
    bench = items.select(F.col(item_key).alias("item"), words_of(item_text).alias("item_words")).where(F.size("item_words") >= SPAN)
    seeds = saved(_seeds(bench, "item_words", lambda i, m: F.lit(True)).select("seed", F.xxhash64("item", "item_words").alias("twin"), F.col("at").alias("item_at")).distinct())
    texts = saved(bench.distinct().select("item", "item_words", F.xxhash64("item", "item_words").alias("twin")))
    sides = F.transform("item_words", lambda w, i: F.xxhash64(w, F.get("item_words", i + 1)))
    pairs = [r[0] for r in texts.select(F.explode(sides)).distinct().limit(PAIRS + 1).collect()]
    frame = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), words_of(text).alias("words"))
    if len(pairs) <= PAIRS:
        # as text: thousands of literals made one by one cost the driver many seconds
        known = F.expr(f"transform(words, (w, i) -> xxhash64(w, get(words, i + 1)) IN ({', '.join(f'{x}L' for x in pairs) or 'NULL'}))")
        # a one-element explode: the filter stays above it, instead of computing words and pairs once more
        frame = frame.select("*", F.explode(F.array(known)).alias("known"))
        # one letter a pair; a pattern tells whether any window is left
        letters = F.array_join(F.transform("known", lambda k: F.when(k, "1").otherwise("0")), "")
        frame = frame.where(letters.rlike("|".join("".join("1" if i in _sides(m) else "." for i in range(SPAN - 1)) for m in range(len(MASKS)))))

        def usable(i: Column, m: int) -> Column:
            return reduce(Column.__and__, (F.get("known", i + o) for o in _sides(m)))
    else:

        def usable(i: Column, m: int) -> Column:
            return F.lit(True)

    probes = _seeds(frame, "words", usable).select("key", "mark", "seed", "at")
    n = seeds.limit(BROADCAST_ROWS + 1).count()
    hits = join_checked(probes, seeds, "seed", "inner", n)
    diagonals = saved(hits.select("key", "mark", "twin", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    own = docs.select(F.col(key).alias("key_"), F.xxhash64(text).alias("mark_"), F.col(text).alias("text_"))
    named = join_checked(own, diagonals.select("key", "mark").distinct(), F.col("key_").eqNullSafe(F.col("key")) & (F.col("mark_") == F.col("mark")), "left_semi")
    fetched = named.select("key_", "mark_", words_of("text_").alias("words")).dropDuplicates(["key_", "mark_"])
    both = fetched.join(diagonals, F.col("key_").eqNullSafe(F.col("key")) & (F.col("mark_") == F.col("mark")))
    begin = F.greatest(F.lit(0), -F.col("shift"))
    cut = both.select("key", "mark", "twin", begin.alias("begin"), F.slice("words", begin + F.col("shift") + 1, F.lit(1 << 30)).alias("rest"))
    cut = join_checked(cut, texts, "twin", "inner", n)
    last = F.least(F.size("rest"), F.size("item_words") - F.col("begin")) - 1
    same = F.transform(F.sequence(F.lit(0), last), lambda k: F.get("rest", k) == F.get("item_words", F.col("begin") + k))
    scored = cut.select("key", "mark", "item", F.size("item_words").alias("length"), same.alias("same")).select("key", "mark", "item", "length", _best("same").alias("best"))
    scored = scored.where(F.col("best.score") >= F.least(F.lit(least), F.col("length")))
    best = F.max(F.struct("best.score", "best.matches")).alias("best")
    return scored.groupBy("key", "mark", "item").agg(best).select("key", "mark", "item", "best.score", "best.matches")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 10) -> DataFrame:
    """(key, contaminated, n_items, item_id, overlap) for each row of ``docs``.

    contaminated: some item overlaps with ``least`` points or more; n_items: how many do;
    item_id and overlap: the item that overlaps best (ties: the smallest id) and its
    matching words; null and 0 if there is none.

    Words are compared in lower case and without punctuation. A null or short text is clean;
    items of fewer than 8 words, and null ones, have no seed and match nothing; keys are of any type;
    repeated rows, and rows that share a null key and a text, get the same verdict; an empty table
    of documents gives an empty result, an empty benchmark leaves all clean; very long texts and
    items are compared whole. Other columns are not read.
    """
    found = overlaps(docs, items, key, text, item_key, item_text, least)
    top = F.min_by(F.struct("item", "matches"), F.struct(-F.col("score"), F.col("item").isNull(), F.col("item"))).alias("top")
    marked = saved(found.groupBy("key", "mark").agg(F.count("*").alias("n_items"), top))
    own = docs.select(F.col(key).alias("key_"), F.xxhash64(text).alias("mark_"))
    out = join_checked(own, marked, F.col("key_").eqNullSafe(F.col("key")) & (F.col("mark_") == F.col("mark")), "left")
    return out.select(F.col("key_").alias(key), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.col("top.item").alias("item_id"), F.coalesce("top.matches", F.lit(0)).cast("bigint").alias("overlap"))


def remove_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that overlap with an item; all columns stay as they are."""
    found = saved(overlaps(docs, items, key, text, **how).select(F.col("key").alias("_key"), F.col("mark").alias("_mark")).distinct())
    same = found["_key"].eqNullSafe(docs[key]) & (found["_mark"] == F.xxhash64(docs[text]))
    return join_checked(docs, found, same, "left_anti")
