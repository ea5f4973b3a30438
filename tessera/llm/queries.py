"""The operators of this folder as queries over the test tables, and SQL for them where SQL can tell the result.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import clustering, decontam, langid, licenses, lm, minhash, mixing, quality, simhash, substring_dedup, urlfilter, warc, whitening
from tessera.llm._storage import removed, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("row.doc_id", *(F.col(f"stats.{c}") for c in counts), "base_failed", "kept", F.col("rule").cast("int").alias("rule"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    found = warc.round_trip(_table(spark, sf_dir, "pages"), folder)
    removed(spark, folder)
    return found


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("place") + 1).alias("explained"), "identity_error")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op11 counts and how far each vector is from the mean: SQL can tell it."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).select("vec_id", "n", "deviation")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 counts, without the learned list: SQL can tell it."""
    judged = quality.judge(_table(spark, sf_dir, "documents"), quality.DecisionList())
    return judged.select("row.doc_id", *(F.col(f"stats.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 aims at, without the draw: SQL can tell it."""
    return mixing.taken(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7's rules say, without the propagation: SQL can tell it."""
    judged = urlfilter.judge(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_substring_dedup, op3_lm_scoring, op4_quality_rules, op5_source_mixing, op6_decontamination, op7_url_filters, op8_simhash_dedup, op9_warc, op10_language_id, op11_embedding_whitening, op12_centroid_clustering, op13_minhash_dedup, quality_counts, mixing_targets, url_rules, whitening_deviations)
}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _license_sql() -> str:
    """Every phrase at every place and every template against every block, without any filter."""
    phrases = [(p.split(), label) for p, label in licenses.PHRASES]
    places = ", ".join("list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p)) + f") AS p{n}" for n, (p, _) in enumerate(phrases))
    base = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, (_, label) in enumerate(phrases))
    every = "list_concat(" + ", ".join(f"p{n}" for n in range(len(phrases))) + ")"
    known = licenses.known_templates()
    rows = ", ".join(f"({k.number}, '{k.label}', {_list(k.tokens)}, {k.need}, {k.step})" for k in known)
    steps = " UNION ALL ".join(f"SELECT rid, {x} AS step, w, unnest(range(0, greatest(len(w), 1), {x})) AS s FROM texts" for x in sorted({k.step for k in known}))
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
found AS (SELECT rid, doc_id, len(w) AS n_words, {places} FROM texts),
based AS (SELECT *, {every} AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM found),
templates(number, label, tokens, need, step) AS (VALUES {rows}),
blocks AS (SELECT rid, step, s, list_distinct(w[s + 1 : s + 2 * step]) AS b FROM ({steps})),
met AS (SELECT rid, step, s, number, label, tokens, len(list_intersect(tokens, b)) AS met, need FROM blocks JOIN templates USING (step)),
enough AS (SELECT * FROM met WHERE met >= need),
largest AS (SELECT * FROM enough AS e WHERE NOT EXISTS (SELECT 1 FROM enough AS o WHERE o.rid = e.rid AND o.step = e.step AND o.s = e.s AND len(o.tokens) > len(e.tokens) AND list_has_all(o.tokens, e.tokens))),
best AS (SELECT rid, list(DISTINCT label) AS more, max(met / len(tokens)) AS best FROM largest GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ','), '') AS labels,
       CAST(greatest(coalesce(best, 0), CASE WHEN len(places) > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS score
FROM based LEFT JOIN best USING (rid)"""


def _rules_sql() -> str:
    rules = sorted(urlfilter.RULES, key=lambda r: (-len(r[1]), r[1]))
    cases = {"rule": "", "ruled": ""}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN "
        cases["rule"] += fits + f"'{rule}' "
        cases["ruled"] += fits + f"'{verdict}' "
    return f"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)
SELECT page_id, host, path, CASE {cases["rule"]}END AS rule, CASE {cases["ruled"]}END AS ruled FROM parts"""


def _clustering_sql() -> str:
    """Every vector against every centroid, round by round."""
    k, rounds, scale, seed = clustering.CLUSTERS, clustering.ROUNDS, clustering.SCALE, clustering.SEED
    parts = [
        f"""kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM kept ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS (SELECT rid, min(s).c AS c, min(s).d AS d FROM (SELECT rid, {{'d': CAST(list_dot_product(kept.x, kept.x) + list_dot_product(c{i}.x, c{i}.x) - 2 * list_dot_product(kept.x, c{i}.x) AS BIGINT), 'c': c}} AS s FROM kept, c{i}) GROUP BY rid)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS (SELECT c{i}.c, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN (SELECT c, list(v ORDER BY p) AS x FROM (SELECT c, p, floor(sum(v) / count(*)) AS v FROM
  (SELECT a{i}.c, unnest(range(1, 65)) AS p, unnest(kept.x) AS v FROM kept JOIN a{i} USING (rid)) GROUP BY c, p) GROUP BY c) AS m ON c{i}.c = m.c)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c{rounds}.x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (rid) JOIN c{rounds} USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op12_centroid_clustering": _clustering_sql(),
    "op13_minhash_dedup": rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM texts),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
-- every pair that shares a shingle
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM shingles AS x JOIN shingles AS y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept FROM sets LEFT JOIN least ON doc_id = a""",
    "whitening_deviations": f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
entries AS (SELECT rid, vec_id, unnest(range(len(embedding))) AS p, CAST(floor({whitening.SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) + {whitening.OFFSET} AS x FROM kept),
told AS (SELECT *, sum(x) OVER (PARTITION BY p) AS s, count(*) OVER (PARTITION BY p) AS n FROM entries)
SELECT vec_id, n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM told GROUP BY rid, vec_id, n""",
    "url_rules": _rules_sql(),
    "quality_counts": r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
twins AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM twins, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
counted AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM texts LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted""",
    "mixing_targets": r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM sized GROUP BY source),
-- the sources that reach three times their size are those with the least size a weight
turns AS (SELECT *, sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER before, 0) AS left_words, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_weight
  FROM sources WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, left_words * weight > 3 * source_size * left_weight AS full_up FROM turns),
rest AS (SELECT (SELECT sum(source_size) FROM capped) - coalesce(3 * sum(source_size) FILTER (full_up), 0) AS words, sum(weight) FILTER (NOT full_up) AS weights FROM capped),
aims AS (SELECT source, source_size, CASE WHEN full_up THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(words AS DOUBLE) * weight / weights END AS target FROM capped, rest)
SELECT doc_id, size, source_size, target FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source""",
    "op1_license_scan": _license_sql(),
    "op2_substring_dedup": r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35),
windows AS (SELECT rid, i, array_to_string(w[i : i + 34], ' ') AS seq FROM places),
repeated AS (SELECT rid, i FROM windows WHERE seq IN (SELECT seq FROM windows GROUP BY seq HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS k FROM repeated),
lost AS (SELECT rid, list(k) AS ks, count(*) AS n FROM gone GROUP BY rid),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM texts),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY k) AS kept FROM words ANTI JOIN gone USING (rid, k) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)""",
    "op9_warc": r"""
WITH raw AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
named AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
  array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, CAST(5 * k + 1 AS INT), 5))::BIGINT >> CAST(s AS INT)) & 31) + 1 AS INT), 1)), '')), '') AS digest FROM raw)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM named""",
}
