"""Keyword search by BM25, over texts as they are or over a kept index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import keyword_batch
from tessera.operators.small import small
from tessera.sources.scratch import kept, saved

# The usual constants of the Okapi variant.
K1, B, EPSILON = 1.5, 0.75, 0.25


#: Distinct query tokens up to which they are looked for by a literal set; beyond it by a join.
VOCABULARY = 5000
#: Tokens of all queries, repeats within a query left out, up to which matches are joined; more queries are answered by one pass over the documents.
JOINED = 1000
#: Documents of a block of a kept index, about.
BLOCK = 32
#: Blocks that a task makes at a time.
GROUP = 32
#: Blocks with the highest bounds that a query scores first; what it finds there is the score that the rest must be able to reach.
FIRST = 16


@dataclass(frozen=True)
class Corpus:
    """Documents as token lists (key, toks); statistics are made when a search needs them."""

    tokens: DataFrame


@dataclass(frozen=True)
class Postings:
    """Postings (token, key, tf, dl) and lengths (key, dl, toks) of some documents, whose statistics count."""

    postings: DataFrame
    lengths: DataFrame


@dataclass(frozen=True)
class Index:
    """A kept index of one or more segments.

    blocks: (segment, token, block, n, max_tf, min_dl, rows array of (key, tf, dl)), sorted by token: the postings of a token by
    blocks of documents, with what bounds the share of each of them in a score. lengths: (segment, key, dl, toks), toks
    the whole token list. vocabulary (token, df) and totals
    (n, total) are sums: several rows add up. gone: (segment, key) of documents that later segments have replaced.
    """

    blocks: DataFrame
    lengths: DataFrame
    vocabulary: DataFrame
    totals: DataFrame
    gone: DataFrame | None = None

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (segment, key, ...) of documents that are still there."""
        return rows if self.gone is None else rows.join(small(self.gone), ["segment", "key"], "left_anti")

    def postings(self) -> DataFrame:
        """(token, key, tf, dl)"""
        return self.live(self.blocks.select("segment", "token", F.explode("rows").alias("r")).select("segment", "token", "r.*")).drop("segment")

    def only(self, keys: DataFrame) -> Postings:
        """The part for the documents of ``keys`` (key); the statistics are those of what is left."""
        lengths = self.live(self.lengths).drop("segment")
        return Postings(self.postings().join(small(keys), "key", "left_semi"), lengths.join(small(keys), "key", "left_semi"))


def build(corpus: DataFrame, key: str = "key", text: str = "text", segment: str = "") -> Index:
    """The index of ``corpus`` as one segment, to be written; each document is tokenised once for the postings.

    Documents are dealt to blocks by a hash of the key and shuffled once, as token lists, by groups of blocks; a task makes
    the postings of a group, so a token that most documents have is dealt out too.
    """
    own = index(corpus, key, text).tokens
    made = _made(own.select("key", "toks", F.size("toks").alias("dl"), _place(corpus.count())))
    return _summed(made.select(F.lit(segment).alias("segment"), "*"), own.select(F.lit(segment).alias("segment"), "key", F.size("toks").alias("dl"), "toks"))


def _place(n: int) -> Column:
    """The block of a document, of ``n`` in all."""
    return F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // BLOCK)))).cast("int").alias("block")


def _groups(rows: DataFrame) -> GroupedData:
    return rows.groupBy(F.floor(F.col("block") / GROUP).alias("g"))


def _made(rows: DataFrame) -> DataFrame:
    """The blocks of documents (key, toks, dl, block)."""
    kind = rows.select("key").schema.simpleString().removeprefix("struct<key:").removesuffix(">")
    return _groups(rows).applyInArrow(lambda t: keyword_batch.blocks(t), f"token string, block int, n int, max_tf int, min_dl int, rows array<struct<key:{kind},tf:int,dl:int>>")


def _summed(blocks: DataFrame, lengths: DataFrame) -> Index:
    """A segment with its sums."""
    vocabulary = blocks.groupBy("token").agg(F.sum("n").alias("df"))
    return Index(blocks, lengths, vocabulary, lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total")))


def write(found: Index, path: str) -> None:
    """Write a segment below ``path``. Blocks are sorted by token, so a search reads only the parts with its tokens; the sums are made from what was written."""
    spark = found.blocks.sparkSession
    found.blocks.drop("segment").repartitionByRange("token", "block").sortWithinPartitions("token", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    found.lengths.drop("segment").write.mode("overwrite").parquet(f"{path}/lengths")
    made = _summed(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/lengths"))
    made.vocabulary.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/vocabulary")
    made.totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def read(spark: SparkSession, path: str, segment: str = "") -> Index:
    """The segment below ``path``, by the name ``segment``."""
    blocks, lengths, vocabulary, totals = (spark.read.parquet(f"{path}/{x}") for x in ("blocks", "lengths", "vocabulary", "totals"))
    named = F.lit(segment).alias("segment")
    if "toks" not in lengths.columns:  # written before token lists were kept
        rows = blocks.select("token", F.explode("rows").alias("r")).select("r.key", F.array_repeat("token", F.col("r.tf")).alias("t"))
        lengths = lengths.join(rows.groupBy("key").agg(F.flatten(F.collect_list("t")).alias("toks")), "key", "left").select("key", "dl", F.coalesce("toks", F.array().cast("array<string>")).alias("toks"))
    return Index(blocks.select(named, "*"), lengths.select(named, "*"), vocabulary, totals)


def joined(segments: list[Index], gone: DataFrame | None = None, lost: tuple[DataFrame, DataFrame] | None = None) -> Index:
    """Segments as one index; ``gone`` tells the documents that are no more, ``lost`` what they had in vocabulary and totals, as negative numbers."""
    blocks, lengths, vocabulary, totals = ([getattr(s, x) for s in segments] for x in ("blocks", "lengths", "vocabulary", "totals"))
    if lost is not None:
        vocabulary.append(lost[0])
        totals.append(lost[1])
    return Index(*(reduce(DataFrame.unionByName, p) for p in (blocks, lengths, vocabulary, totals)), gone)


def lost(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(segment, token, df) and (segment, n, total), negative: what ``documents`` (segment, text) take from the sums when they go."""
    own = documents.select("segment", T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks"))
    words = own.select("segment", F.explode(F.array_distinct("toks")).alias("token")).groupBy("segment", "token").agg((-F.count("*")).alias("df"))
    return words, own.groupBy("segment").agg((-F.count("*")).alias("n"), (-F.sum(F.size("toks"))).cast("bigint").alias("total"))


def index(corpus: DataFrame, key: str = "key", text: str = "text", where: Column | None = None) -> Corpus:
    """Token lists of ``corpus``; ``where`` filters it first, so the statistics are those of what is left."""
    own = corpus if where is None else corpus.where(where)
    return Corpus(own.select(F.col(key).alias("key"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks")))


def document_frequency(corpus: Corpus | Postings | Index) -> DataFrame:
    """(token, df) of every token; documents count each token once."""
    if isinstance(corpus, Index):
        return corpus.vocabulary.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    if isinstance(corpus, Postings):
        return corpus.postings.groupBy("token").agg(F.count("*").alias("df"))
    return corpus.tokens.select(F.explode(F.array_distinct("toks")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def _idf(df: Column, n: int) -> Column:
    return F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)


def _share(tf: Column, dl: Column, mean: float) -> Column:
    """What a token of a document adds to a score, but for the weight of the token."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean or 1.0)))


def _weights(stats: DataFrame, n: int, corpus: Corpus | Postings | Index) -> DataFrame:
    """(token, idf) of query tokens (token, df); an idf below 0 becomes EPSILON times the mean idf of all tokens."""
    weights = stats.select("token", _idf(F.col("df"), n).alias("idf"))
    if not weights.where("idf < 0").isEmpty():
        mean = document_frequency(corpus).agg(F.avg(_idf(F.col("df"), n))).first()[0]
        weights = weights.withColumn("idf", F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf")))
    return weights


def _terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(T.tokens(F.coalesce(F.col("text"), F.lit("")))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def _none(queries: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return queries.select("query_id", F.lit(None).cast(keys.schema["key"].dataType).alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)


def _best(scores: DataFrame, k: int, key: str) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "score", "rank")


def search(queries: DataFrame, corpus: Corpus | Postings | Index, k: int, key: str = "key", digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` highest scores above 0 for each query (query_id, text).

    A query token counts as often as it stands in the query. An idf below 0 becomes EPSILON
    times the mean idf of all tokens of the corpus; that mean is only computed if some query
    token needs it. Scores are rounded to ``digits``, ties go to the smallest key.

    Without an index two passes over the corpus are made: one counts its documents, their tokens and the
    documents of each query token; the other scores each document where it is read, so what is shuffled
    is one row for each query and matching document. With a kept index nothing is tokenised, and
    blocks that can't reach a query's k-th best score are passed over (see ``_waves``).

    Those ways hold a row for each query and document (or block) with a common token. So queries with
    more than JOINED tokens in all go to the documents instead (see ``_scan``).
    """
    if _many(queries):
        return _scan(queries, corpus, k, key, digits)
    if isinstance(corpus, Index):
        found = _waves(queries, corpus, k, digits)
        return _none(queries, corpus.lengths, key) if found is None else _best(reduce(DataFrame.unionByName, found.scores), k, key)
    terms = _terms(queries)
    words = terms.select("token").distinct()
    vocabulary = [r[0] for r in words.limit(VOCABULARY + 1).collect()]
    whole = isinstance(corpus, Postings)
    if whole:
        known = F.col("token").isin(vocabulary) if vocabulary else F.lit(False)
        counts = corpus.postings.where(known) if len(vocabulary) <= VOCABULARY else corpus.postings.join(small(words), "token", "left_semi")
        n, total = corpus.lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        stats = counts.groupBy("token").agg(F.count("*").alias("df"))
    else:
        found = corpus.tokens.select("key", F.size("toks").alias("dl"), "toks")
        if len(vocabulary) <= VOCABULARY:
            found = found.withColumn("toks", F.filter("toks", lambda t: t.isin(vocabulary) if vocabulary else F.lit(False)))
        # the empty token stands for the document itself
        marks = found.select("dl", F.explode(F.array_union(F.array(F.lit("")), F.array_distinct("toks"))).alias("token"))
        if len(vocabulary) > VOCABULARY:
            marks = marks.join(small(words.unionByName(words.sparkSession.createDataFrame([("",)], "token string"))), "token", "left_semi")
        stats = marks.groupBy("token").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))
        counts = found.select("key", "dl", F.explode("toks").alias("token")).groupBy("key", "dl", "token").agg(F.count("*").alias("tf"))
    if len(vocabulary) <= VOCABULARY:
        rows = stats.collect()
        if not whole:
            n, total = next(((r["df"], r["total"]) for r in rows if r["token"] == ""), (0, 0))
        stats = words.sparkSession.createDataFrame([(r["token"], r["df"]) for r in rows if r["token"]], "token string, df long")
    elif not whole:
        n, total = stats.where("token = ''").select("df", "total").first() or (0, 0)
        stats = stats.where("token <> ''")
    if not n:
        return _none(queries, corpus.lengths if whole else corpus.tokens, key)
    asked = terms.join(_weights(stats, n, corpus), "token")
    part = F.col("qtf") * F.col("idf") * _share(F.col("tf"), F.col("dl"), total / n)
    scores = counts.join(small(asked), "token").groupBy("query_id", "key").agg(F.round(F.sum(part), digits).alias("score")).where("score > 0")
    return _best(scores, k, key)


def _many(queries: DataFrame) -> bool:
    """Whether the queries have more than JOINED tokens; more queries than that with a token needn't be read."""
    n = F.size(F.array_distinct(T.tokens(F.coalesce(F.col("text"), F.lit("")))))
    return (queries.select(n.alias("n")).where("n > 0").limit(JOINED + 1).agg(F.sum("n")).first()[0] or 0) > JOINED


def _texts(documents: DataFrame) -> DataFrame:
    """Token lists (key, toks) as (key, dl, words)."""
    return documents.select("key", F.size("toks").alias("dl"), F.array_join("toks", " ").alias("words"))


def _scan(queries: DataFrame, corpus: Corpus | Postings | Index, k: int, key: str, digits: int) -> DataFrame:
    """``search`` by a pass over the token lists: tasks score their documents with all queries and pass on the best ``k`` of each query."""
    if isinstance(corpus, Index):
        sums = corpus.totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        return _scanned(queries, document_frequency(corpus), _texts(corpus.live(corpus.lengths)), sums, k, key, digits)
    # read several times, so kept while the search runs
    with kept(_texts(corpus.tokens if isinstance(corpus, Corpus) else corpus.lengths)) as texts:
        sums = texts.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return _scanned(queries, saved(keyword_batch.frequencies(texts)), texts, sums, k, key, digits)


def _scanned(queries: DataFrame, stats: DataFrame, documents: DataFrame, sums: tuple[int, int], k: int, key: str, digits: int) -> DataFrame:
    n, mean = sums[0], (sums[1] / sums[0] if sums[0] else 0.0) or 1.0
    if not n:
        return _none(queries, documents, key)
    found = keyword_batch.search(_weighted(queries, stats, n), documents, lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)), k, digits)
    query = F.from_json("id", queries.select("query_id").schema)["query_id"].alias("query_id")
    return _none(queries, documents, key) if found is None else found.select(query, F.col("key").alias(key), "score", "rank")


def _weighted(queries: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """(id, token, weight) of the queries' tokens by the corpus's (token, df), the query_id as JSON."""
    idf = _idf(F.col("df"), n)
    mean = stats.agg(F.avg(idf)).first()[0]
    weights = stats.select("token", F.when(idf < 0, F.lit(EPSILON) * F.lit(mean)).otherwise(idf).alias("idf"))
    terms = _terms(queries).select(F.to_json(F.struct("query_id")).alias("id"), "token", "qtf")
    return terms.join(weights, "token").select("id", "token", (F.col("qtf") * F.col("idf")).alias("weight"))


@dataclass(frozen=True)
class _Waves:
    """bounds (query_id, segment, block, bound, postings) of all blocks with a query token; scored: those of each wave; scores (query_id, key, score) of each wave."""

    bounds: DataFrame
    scored: list[DataFrame]
    scores: list[DataFrame]


def _waves(queries: DataFrame, found: Index, k: int, digits: int) -> _Waves | None:
    """The documents that may be among a query's ``k`` best, with their scores; none: the index is empty.

    A token adds no more to the score of a document of a block than it would in one of the block's largest count and least
    length, so the sum of these bounds a block. Each query scores the FIRST blocks with the highest bounds; then only
    blocks whose bound reaches the k-th score found there can matter, and all of those are scored. A
    collection of few blocks is scored at once.
    """
    n, total = found.totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    if not n:
        return None
    terms = _terms(queries)
    words = terms.select("token").distinct()
    vocabulary = [r[0] for r in words.limit(VOCABULARY + 1).collect()]
    if len(vocabulary) <= VOCABULARY:
        only = lambda df: df.where(F.col("token").isin(vocabulary) if vocabulary else F.lit(False))
    else:
        only = lambda df: df.join(small(words), "token", "left_semi")
    stats = only(found.vocabulary).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    if len(vocabulary) <= VOCABULARY:
        stats = stats.sparkSession.createDataFrame(stats.collect(), "token string, df long")
    asked = saved(terms.join(_weights(stats, n, found), "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight")))
    blocks, mean = only(found.blocks).join(small(asked), "token"), total / n
    most = F.greatest("weight", F.lit(0.0)) * _share(F.col("max_tf"), F.col("min_dl"), mean)
    place = ["query_id", "segment", "block"]
    bounds = blocks.groupBy(*place).agg(F.sum(most).alias("bound"), F.sum("n").alias("postings"))

    def score(rows: DataFrame) -> DataFrame:
        rows = rows.select("query_id", "segment", "weight", F.explode("rows").alias("r")).select("query_id", "segment", "weight", "r.*")
        part = F.col("weight") * _share(F.col("tf"), F.col("dl"), mean)
        return found.live(rows).groupBy("query_id", "key").agg(F.round(F.sum(part), digits).alias("score")).where("score > 0")

    if n <= BLOCK * FIRST:
        return _Waves(bounds, [bounds], [score(blocks)])
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "segment", "block"))
    bounds = saved(bounds.withColumn("turn", turn))
    first = bounds.where(F.col("turn") <= FIRST)
    begun = saved(score(blocks.join(small(first.select(*place)), place, "left_semi")))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    kth = begun.withColumn("turn", F.row_number().over(best)).where(F.col("turn") == k).select("query_id", F.col("score").alias("kth"))
    # a rounded score may lie half a unit of the last digit above its bound
    reach = F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 10.0**-digits)
    rest = saved(bounds.where(F.col("turn") > FIRST).join(small(kth), "query_id", "left").where(reach).select(*bounds.columns))
    return _Waves(bounds, [first, rest], [begun, score(blocks.join(small(rest.select(*place)), place, "left_semi"))])


def reads(queries: DataFrame, found: Corpus | Index, k: int, digits: int = 6) -> DataFrame:
    """(query_id, blocks, blocks_scored, postings, postings_scored): what the query's tokens have in the index, and what its search took.

    Queries that search answers by a pass over the documents take all that they have. Documents without an index
    count as in the one that ``build`` makes of them; what of it no query asks for isn't made.
    """
    if _many(queries):
        return _reads_of_a_scan(queries, found)
    waves = _waves(queries, found if isinstance(found, Index) else _asked_index(queries, found), k, digits)
    if waves is None:
        return _no_reads(queries)
    every = waves.bounds.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum("postings").alias("postings"))
    took = reduce(DataFrame.unionByName, waves.scored).groupBy("query_id").agg(F.count("*").alias("blocks_scored"), F.sum("postings").alias("postings_scored"))
    return every.join(took, "query_id", "left").select("query_id", "blocks", F.coalesce("blocks_scored", F.lit(0)).alias("blocks_scored"), "postings", F.coalesce("postings_scored", F.lit(0)).alias("postings_scored"))


def _no_reads(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", *(F.lit(0).cast("bigint").alias(x) for x in ("blocks", "blocks_scored", "postings", "postings_scored"))).limit(0)


def _asked_index(queries: DataFrame, corpus: Corpus) -> Index:
    """The index of ``corpus`` with the blocks of the queries' tokens only, JOINED at most."""
    vocabulary = [r[0] for r in _terms(queries).select("token").distinct().collect()]
    known = F.filter("toks", lambda t: t.isin(vocabulary) if vocabulary else F.lit(False))
    lengths = corpus.tokens.select(F.lit("").alias("segment"), "key", F.size("toks").alias("dl"), "toks")
    rows = lengths.select("key", known.alias("toks"), "dl", _place(corpus.tokens.count()))
    blocks = saved(_made(rows).select(F.lit("").alias("segment"), "*"))
    return Index(blocks, lengths, document_frequency(corpus), _summed(blocks, lengths).totals)


def _reads_of_a_scan(queries: DataFrame, found: Corpus | Index) -> DataFrame:
    if isinstance(found, Index):
        tokens = found.blocks.groupBy("segment", "block").agg(F.collect_list(F.struct("token", "n")).alias("t")).select(F.col("t.token").alias("toks"), F.col("t.n").alias("n"))
    else:
        rows = found.tokens.select(F.array_distinct("toks").alias("toks"), _place(found.tokens.count()))
        tokens = _groups(rows).applyInArrow(lambda t: keyword_batch.block_tokens(t), "toks array<string>, n array<int>")
    with kept(tokens) as blocks:
        counts = keyword_batch.counted(_terms(queries).select(F.to_json(F.struct("query_id")).alias("id"), "token"), blocks)
    query = F.from_json("id", queries.select("query_id").schema)["query_id"].alias("query_id")
    return _no_reads(queries) if counts is None else counts.select(query, "blocks", F.col("blocks").alias("blocks_scored"), "postings", F.col("postings").alias("postings_scored"))
