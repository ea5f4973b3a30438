"""License scans by an exact set-similarity join of license templates and text blocks.

Templates of up to 32 words are looked for in blocks of 64 consecutive words that start at every
32nd word, so a notice lies wholly in one; longer templates, whole license texts among them, in
blocks and steps twice, four times and so on as long. A block meets a template if it contains the threshold's share of the
template's tokens. The join: tokens are ordered by their document frequency over the whole
corpus, the rarest first; of a template only the prefix is indexed that must meet any block
above the threshold; blocks probe it, and length and positional filters drop pairs that
can't reach the threshold; the rest is verified exactly. Where a block meets two templates and
one has all tokens of the other, the larger one counts. Texts are tokenised once; only those
that have enough tokens of some template keep their words, and are cut into blocks. All of
it is built-in Spark expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._joins import join_checked
from tessera.llm._storage import saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words from the start of a block of the shortest templates to that of the next; a block is two steps long.
STEP = 32
THRESHOLD = 0.9
# Phrases that are looked up as they stand, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Opening or defining sentences of public licenses, with the labels for them.
TEMPLATES = (
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class Template:
    """Its distinct tokens, how many of them must be met, and the step of the blocks that it is looked for in."""

    number: int
    label: str
    tokens: tuple[str, ...]
    need: int
    step: int


def known_templates(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    out = []
    for i, (label, text) in enumerate(templates):
        words = text.split()
        tokens, step = tuple(dict.fromkeys(words)), STEP
        while step < len(words):
            step *= 2
        out.append(Template(i, label, tokens, max(1, math.ceil(threshold * len(tokens) - 1e-9)), step))
    return out


def frequency_order(frame: DataFrame, present: str, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` from the rarest token to the most frequent one, by the rows of ``frame`` that have it."""
    counts = frame.select(F.explode(present).alias("t")).groupBy("t").count().collect()
    seen = {r["t"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda t: (seen.get(t, 0), t))


def _phrase_places(words: str, phrase: list[str]) -> Column:
    """Places where the phrase starts; wanted only where its rarest word is known to be."""
    places = F.sequence(F.lit(0), F.size(words) - len(phrase))

    def here(i: Column) -> Column:
        out = F.get(words, i) == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            out = out & (F.get(words, i + k) == p)
        return out

    # sequence() counts down where the text is shorter than the phrase
    return F.when(F.array_contains(words, max(phrase, key=len)) & (F.size(words) >= len(phrase)), F.filter(places, here)).otherwise(F.array().cast("array<int>"))


def block_matches(frame: DataFrame, words: str, known: list[Template], order: list[str]) -> DataFrame:
    """The columns of ``frame`` but words, with (label, score) for each template that a block meets.

    ``known``: templates of one step; ``order``: the tokens of all, the rarest first; score: the share of
    the template's tokens that the block contains.
    """
    spark, step = frame.sparkSession, known[0].step
    rank = {t: i for i, t in enumerate(order)}
    index, prefixes = [], set()
    for k in known:
        tokens = sorted(k.tokens, key=rank.__getitem__)
        for p, t in enumerate(tokens[: len(tokens) - k.need + 1]):
            index.append((t, k.number, p, k.need, tokens))
            prefixes.add(t)
    prefix = spark.createDataFrame(index, "token string, template int, p int, need int, tokens array<string>")
    rest = [c for c in frame.columns if c != words]
    own = [t for t in order if any(t in k.tokens for k in known)]
    flagged = frame.where(F.exists(words, lambda w: w.isin(*sorted(prefixes))))
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
    blocks = flagged.select(*rest, F.posexplode(F.transform(starts, lambda s: F.array_intersect(F.array(*map(F.lit, own)), F.slice(F.col(words), s + 1, F.lit(2 * step))))).alias("block", "b"))
    probes = blocks.select(*rest, "block", "b", F.posexplode("b").alias("q", "token"))
    pairs = join_checked(probes, prefix, "token", "inner", len(index))
    # length, then position: what is left of both sides from the shared token on must do
    pairs = pairs.where(F.size("b") >= F.col("need")).where(F.least(F.size("tokens") - F.col("p"), F.size("b") - F.col("q")) >= F.col("need"))
    met = F.size(F.array_intersect("tokens", "b"))
    found = pairs.where(met >= F.col("need")).groupBy(*rest, "block").agg(F.collect_set(F.struct("template", (met / F.size("tokens")).alias("score"))).alias("met"))
    numbers = F.transform("met", lambda m: m["template"])
    larger = {k.number: [o.number for o in known if set(k.tokens) < set(o.tokens)] for k in known}

    def stays(m: Column) -> Column:
        lesser = [(m["template"] == k) & F.arrays_overlap("numbers", F.array(*map(F.lit, over))) for k, over in larger.items() if over]
        return ~reduce(Column.__or__, lesser, F.lit(False))

    left = found.select(*rest, "met", numbers.alias("numbers")).select(*rest, F.explode(F.filter("met", stays)).alias("m"))
    labels = F.create_map(*(F.lit(x) for k in known for x in (k.number, k.label)))
    return left.select(*rest, labels[F.col("m.template")].alias("label"), "m.score")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    n_base: places where the words of a phrase stand consecutively; first_word, last_word:
    the smallest and largest of them, counted in words from 0, null if there is none;
    base_labels and labels: distinct labels, sorted and joined by commas, of the phrases, and
    of phrases and templates; score: the highest share of a template's tokens met, 1 if a
    phrase was found, 0 if nothing was.

    A null text is an empty one: no word, no label, score 0. Texts and templates are of any
    length and looked through whole. Repeated rows get the same result; rows with a null key are told apart by their text; an empty table gives an empty
    result. Other columns are not read.
    """
    known = known_templates(templates, threshold)
    if not known:
        raise ValueError("no template")
    vocabulary = sorted({t for k in known for t in k.tokens})
    own = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), words_of(text).alias("words"))
    split = [(p.split(), label) for p, label in phrases]
    places = [_phrase_places("words", p).alias(f"p{i}") for i, (p, _) in enumerate(split)]
    seen = own.select("key", "mark", "words", F.size("words").cast("bigint").alias("n_words"), *places, F.array_intersect(F.array(*map(F.lit, vocabulary)), "words").alias("present"))
    # a text that lacks too many tokens of every template has no block that meets one
    reachable = reduce(Column.__or__, (F.size(F.array_intersect(F.array(*map(F.lit, k.tokens)), "present")) >= k.need for k in known))
    found = saved(seen.withColumn("words", F.when(reachable, F.col("words"))))
    order = frequency_order(found, "present", vocabulary)
    rows = found.where("words IS NOT NULL").select("key", "mark", "words")
    by_step = [block_matches(rows, "words", [k for k in known if k.step == step], order) for step in sorted({k.step for k in known})]
    matches = reduce(DataFrame.unionByName, by_step).groupBy("key", "mark").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    met = saved(matches.withColumnsRenamed({"key": "key_", "mark": "mark_"}))
    out = join_checked(found, met, F.col("key").eqNullSafe(F.col("key_")) & (F.col("mark").eqNullSafe(F.col("mark_"))), "left")
    every = F.concat(*(F.col(f"p{i}") for i in range(len(split))))
    base = F.array_distinct(F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, label) for i, (_, label) in enumerate(split)))))
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size(every) > 0, 1.0).otherwise(0.0)).alias("score"),
    )
