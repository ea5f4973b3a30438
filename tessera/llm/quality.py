"""Quality rules: a decision list learned from labelled text statistics.

Every statistic is a built-in Spark expression over the whole text. Sequential covering
learns the list: a rule is grown one threshold condition at a time, each time the one with
the highest gain on the rows that no earlier rule covers; on rows held back from growing it
is then pruned, condition by condition, while that doesn't lower its worth, and is kept only if it is pure
enough there. The list is an ordered chain of Spark conditions, and runs inside the scan.

Learning sees counts only: each step is one aggregation of the labelled sample by
statistic, bin and label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._joins import join_checked
from tessera.llm._sampling import smallest
from tessera.llm._storage import saved

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Labelled rows that the list is fitted on at most; they are those with the smallest hash of the key.
SAMPLE_ROWS = 10_000
FEATURES = ("word_len", "symbol_share", "dup_line_share", "repeat_share", "words", "upper_share", "digit_share", "mark_share", "bare_end_share")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _covered(places: str) -> Column:
    """Size of the union of the 3-word windows at the sorted ``places``."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last"))
    step = F.aggregate(places, start, lambda s, p: F.struct((s["sum"] + F.least(F.lit(3), p - s["last"])).alias("sum"), p.alias("last")))
    return step["sum"]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its columns and ``stats``, a struct of the text's statistics.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are counts; null: an
    empty text. The rest are shares for learning, 0 where there is nothing to divide by.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), body.alias("t"), _words(body).alias("w"))
    n = F.size("w")
    none = F.array().cast("array<bigint>")
    counted = first.select(
        "row",
        "t",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(none).alias("keys"),
    )
    # Arrays that a lambda looks into stand in columns of their own: inside it they would be made anew for every element.
    repeats = F.size("keys") > F.size(F.array_distinct("keys"))
    pairs = F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    counted = counted.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), F.when(repeats, F.sort_array(pairs)).alias("at")).drop("keys")
    twins = F.filter("at", lambda x, j: (F.get("at", j - 1)["k"] == x["k"]) | (F.get("at", j + 1)["k"] == x["k"]))
    counted = counted.withColumn("places", F.sort_array(F.transform(twins, lambda x: x["i"]))).drop("at")
    counted = counted.withColumn("n_repeat_words", F.coalesce(_covered("places"), F.lit(0)).cast("bigint")).drop("places")

    def share(top: Column, under: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), under.cast("double")), F.lit(0.0))

    words, chars, n_lines = F.col("n_words"), F.col("word_chars"), F.size("lines")
    stats = F.struct(
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share(chars, words).alias("word_len"),
        share(F.col("n_symbols"), words).alias("symbol_share"),
        share(F.col("n_dup_lines"), n_lines).alias("dup_line_share"),
        share(F.col("n_repeat_words"), words).alias("repeat_share"),
        words.cast("double").alias("words"),
        share(F.regexp_count("t", F.lit("[A-Z]")), chars).alias("upper_share"),
        share(F.regexp_count("t", F.lit("[0-9]")), chars).alias("digit_share"),
        share(F.regexp_count("t", F.lit("[!?]")), words).alias("mark_share"),
        share(F.size(F.filter("lines", lambda x: ~x.rlike(r"[.!?:;,\"')\]]\s*$"))), n_lines).alias("bare_end_share"),
    )
    # A one-element explode: a later filter on the statistics stays above it, instead of computing them once more below.
    return counted.select("row", F.explode(F.array(stats)).alias("stats"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self, stats: str = "stats") -> Column:
        x = F.col(f"{stats}.{self.feature}")
        return x > F.lit(self.bound) if self.above else x <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that fits rejects the text; none: it is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def fits(self, rule: tuple[Condition, ...]) -> Column:
        return reduce(Column.__and__, (c.column() for c in rule))

    def rejected_by(self) -> Column:
        """Number of the first rule that fits (from 1), or 0."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            out = F.when(self.fits(rule), i) if out is None else out.when(self.fits(rule), i)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(f"if {' and '.join(map(str, r))} then reject" for r in self.rules) + "\nelse keep"


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """FOIL's gain of a refinement that leaves (bad, good) of (bad0, good0)."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def learn(sample: DataFrame, bins: int = 24, most_rules: int = 12, most_conditions: int = 4, purity: float = 0.9, support: int = 5) -> DecisionList:
    """Decision list from ``sample`` (stats, bad boolean, held boolean), by sequential covering.

    ``held`` rows prune and judge, the others grow. A rule must cover ``support`` held bad
    rows at least, with ``purity`` of its held rows bad, so that clean texts stay.
    """
    cuts = sample.agg(*(F.percentile_approx(F.col(f"stats.{f}"), [i / bins for i in range(1, bins)], 10_000).alias(f) for f in FEATURES)).first()
    bounds = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    conditions = [Condition(f, above, float(b)) for f in FEATURES for b in bounds[f] for above in (True, False)]
    if not conditions:
        return DecisionList()

    def bin_of(f: str) -> Column:
        return reduce(Column.__add__, (F.when(F.col(f"stats.{f}") > b, 1).otherwise(0) for b in bounds[f]), F.lit(0))

    binned = saved(sample.select("stats", "bad", "held", F.array(*(bin_of(f) for f in FEATURES)).alias("bins")).repartition(2))

    def table(where: Column) -> dict[Condition, tuple[int, int]]:
        """(bad, good) of the rows for each condition."""
        rows = binned.where(where).select("bad", F.posexplode("bins")).groupBy("pos", "col", "bad").count().collect()
        count: dict[tuple[int, bool], dict[int, int]] = {}
        for r in rows:
            count.setdefault((r["pos"], r["bad"]), {})[r["col"]] = r["count"]
        out = {}
        for c in conditions:
            p, k = FEATURES.index(c.feature), bounds[c.feature].index(c.bound)
            out[c] = tuple(sum(v for b, v in count.get((p, bad), {}).items() if (b > k) == c.above) for bad in (True, False))
        return out

    def judged(rule: tuple[Condition, ...], free: Column) -> list[tuple[int, int]]:
        """Held (bad, good) of the rule and of the rule without each condition."""
        parts = [rule] + [rule[:i] + rule[i + 1 :] for i in range(len(rule)) if len(rule) > 1]
        fits = [reduce(Column.__and__, (c.column() for c in r)) for r in parts]
        row = binned.where(free & F.col("held")).agg(*(F.count_if(f & (F.col("bad") == b)) for f in fits for b in (True, False))).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(parts))]

    rules: list[tuple[Condition, ...]] = []
    free = F.lit(True)
    while len(rules) < most_rules:
        rule: tuple[Condition, ...] = ()
        bad0, good0 = (sum(x) for x in zip(*(v for c, v in table(free & ~F.col("held")).items() if c.feature == conditions[0].feature and c.bound == conditions[0].bound)))
        if bad0 < support:
            break
        grown = free & ~F.col("held")
        while len(rule) < most_conditions and good0:
            counts = table(grown)
            best = max(counts, key=lambda c: (_gain(*counts[c], bad0, good0), str(c)))
            if _gain(*counts[best], bad0, good0) <= 0:
                break
            rule, (bad0, good0) = (*rule, best), counts[best]
            grown = grown & best.column()
        if not rule:
            break
        scores = judged(rule, free)
        while len(rule) > 1:
            worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in scores]
            best = max(range(1, len(worth)), key=lambda i: worth[i])
            if worth[best] < worth[0]:
                break
            rule = rule[: best - 1] + rule[best:]
            scores = judged(rule, free)
        bad, good = scores[0]
        if bad < support or bad < purity * (bad + good):
            break
        rules.append(rule)
        free = free & ~reduce(Column.__and__, (c.column() for c in rule))
    return DecisionList(tuple(rules))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(stats, bad, held) of ``rows`` labelled documents at most, those with the smallest hash of the key."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("quality"))
    chosen = saved(smallest(chosen.withColumn("_all", F.lit(0)), key, rows, "_all").select(key, "quality"))
    own = join_checked(docs.select(F.col(key), F.col(text)), chosen, key, "inner", rows)
    found = statistics(own.dropDuplicates([key]), text)
    return saved(found.select("stats", (F.col("row.quality") == 0).alias("bad"), (F.pmod(F.xxhash64(F.col(f"row.{key}"), F.lit(1)), F.lit(3)) == 0).alias("held")))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, **how) -> DecisionList:
    """Decision list for ``docs`` from ``labels`` (key, quality: 0 is bad); no labels: it keeps all."""
    sample = labelled_sample(docs, labels, key, text, rows)
    return DecisionList() if sample.isEmpty() else learn(sample, **how)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """(row struct of the input columns, stats, base_failed, rule, kept) for each row of ``docs``.

    base_failed: under 50 words, or over half of the words repeat; rule: the first rule of
    the list that rejects the text, else 0; kept: neither.

    A null or empty text has no words, so it fails; repeated rows get the same verdict each;
    an empty table gives an empty result; other columns, whatever their names, ride along
    in ``row``.
    """
    found = statistics(docs, text)
    words, repeats = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    failed = (words < 50) | (100 * repeats > 50 * words)
    return found.select("row", "stats", failed.alias("base_failed"), rules.rejected_by().alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``judge`` with the list that ``fit`` learns from ``labels``."""
    return judge(docs, fit(docs, labels, key, text, **how), text)
