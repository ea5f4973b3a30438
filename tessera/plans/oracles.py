"""DuckDB SQL that tells the results of the engine's queries, written apart from them."""

from __future__ import annotations

from tessera import config


def _map(table: dict[str, str], key: str, default: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"coalesce(CASE {key} {rows} END, {default})"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


PATHS = "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages"
BASE = "string_split(path, '/')[-1]"
EXT = f"lower(regexp_extract({BASE}, '^.+(\\.[^.]+)$', 1))"
LANGUAGE = _map(config.LANGUAGES, EXT, "'Unknown'")


def _role(path: str) -> str:
    low = f"lower({path})"
    rows = " ".join(f"WHEN contains({low}, '{x}') THEN '{r}'" for x, r in config.PATH_ROLES)
    return _map(config.ROLES, f"lower(string_split({path}, '/')[-1])", f"CASE {rows} END")


TOKENS = "flatten(list_transform(regexp_extract_all(lower({t}), '[a-z_][a-z0-9_]*|[0-9]+'), lambda x: CASE WHEN contains(x, '_') THEN list_concat([x], list_filter(string_split(x, '_'), lambda p: p <> '')) ELSE [x] END))"


def _tokens(t: str) -> str:
    return TOKENS.replace("{t}", t)


COVERAGE = "CAST(len(list_filter(['the', 'license', 'de', 'tion'], lambda k: contains(lower(text), k))) AS DOUBLE) / 4"
HEADER = f"'# File: ' || source || chr(10) || '# Language: ' || lang || chr(10) || coalesce('# Role: ' || {_role('source')} || chr(10), '') || '---' || chr(10)"
SNAPSHOTS = """docs AS (SELECT source || '/' || doc_id AS path, source, lang, text FROM documents),
now_ AS (SELECT path, sha256(CASE WHEN source = 'src5' THEN text || '!' ELSE text END) AS hash FROM docs WHERE source <> 'src3'),
stored AS (SELECT path, sha256(text) AS stored FROM docs WHERE lang <> 'fr'),
found AS (SELECT coalesce(n.path, s.path) AS path, CASE WHEN n.hash IS NULL THEN 'deleted' WHEN s.stored IS NULL THEN 'new' WHEN n.hash <> s.stored THEN 'updated' ELSE 'unchanged' END AS status, n.hash, s.stored
  FROM now_ n FULL JOIN stored s ON n.path = s.path)"""
JUDGED = """judged AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' WHEN toxic = 0 THEN 'incorrect' ELSE 'error' END AS verdict,
  'row ' || doc_id AS reasoning, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0e0 WHEN quality = 1 THEN 0.5e0 ELSE 0.0e0 END AS score FROM labels)"""


# -- retrieval


def _asked(shift: int = 0, variant: int = 0) -> str:
    return f"SELECT b.doc_id - {shift} AS query_id, {variant} AS variant, b.text, e.embedding FROM documents b JOIN embeddings e ON e.vec_id = b.doc_id WHERE (b.doc_id - {shift}) % 50 = 0 AND b.doc_id >= {shift}"


TEXTS_ASKED = "SELECT doc_id AS query_id, 0 AS variant, text FROM documents WHERE doc_id % 50 = 0"


CORPUS = "corpus AS (SELECT d.doc_id, d.text, d.lang, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"
SIM = "round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


def _sim(a: str, b: str) -> str:
    return SIM.replace("{a}", a).replace("{b}", b)


def _bm25(asked: str, corpus: str, k: int, out: str = "words") -> str:
    """CTEs ending in ``out`` (query_id, variant, doc_id, score, rank)."""
    return f"""toks AS MATERIALIZED (SELECT doc_id, {_tokens('text')} AS ts FROM {corpus}),
posts AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS tok FROM toks),
tf AS (SELECT doc_id, dl, tok, count(*) AS tf FROM posts GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS mean_dl FROM toks),
raw AS (SELECT tok, ln(n - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS idf FROM tf, stats GROUP BY tok, n),
idf AS (SELECT tok, CASE WHEN idf < 0 THEN 0.25e0 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
qt AS (SELECT query_id, variant, tok, count(*) AS qtf FROM (SELECT query_id, variant, unnest({_tokens('text')}) AS tok FROM {asked}) GROUP BY ALL),
scored AS (SELECT query_id, variant, doc_id, round(sum(qtf * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / mean_dl))), 6) AS score
  FROM qt JOIN tf USING (tok) JOIN idf USING (tok), stats GROUP BY ALL),
{out} AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= {k})"""


def _knn(asked: str, corpus: str, k: int, out: str = "near") -> str:
    return f"""{out} AS (SELECT query_id, variant, doc_id, {_sim('a.embedding', 'c.embedding')} AS score, row_number() OVER (PARTITION BY query_id, variant ORDER BY {_sim('a.embedding', 'c.embedding')} DESC, doc_id) AS rank
  FROM {asked} a, {corpus} c QUALIFY rank <= {k})"""


def _fused(k: int | None) -> str:
    """Result of CTEs near and words."""
    cut = "" if k is None else f" QUALIFY rank <= {k}"
    return f"""ranks AS (SELECT query_id, doc_id, rank, 2 * variant AS ranking FROM near UNION ALL SELECT query_id, doc_id, rank, 2 * variant + 1 FROM words),
sums AS (SELECT query_id, doc_id, round(sum(1.0e0 / (60 + rank)), 10) AS score, min({{'a': ranking, 'b': rank}}) AS seen FROM ranks GROUP BY ALL),
fused AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_id) AS rank FROM sums{cut})"""


def _rerank(first: str, corpus: str) -> str:
    asked, have = _tokens("a.text"), _tokens("c.text")
    score = f"round(CAST(len(list_intersect(list_distinct({asked}), {have})) AS DOUBLE) / len(list_distinct({asked})), 6)"
    return f"""again AS (SELECT f.query_id, f.doc_id, f.rank AS before, {score} AS score FROM {first} f JOIN asked a USING (query_id) JOIN {corpus} c ON c.doc_id = f.doc_id)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS INT) AS rank FROM again QUALIFY rank <= 6"""


OUT = "SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM "
VECTORS = "asked AS (SELECT vec_id AS query_id, 0 AS variant, embedding, label FROM embeddings WHERE vec_id % 50 = 0), corpus AS (SELECT vec_id AS doc_id, embedding, label FROM embeddings)"
WORDS_OF_DOCUMENTS = f"asked AS ({_asked()}), " + _bm25("asked", "documents", 20)
WORDS_OF_ALL = f"asked AS ({TEXTS_ASKED}), " + _bm25("asked", "documents", 20)


def _mmr(k: int = 6, fetch: int = 20) -> str:
    """CTEs ending in picks (query_id, doc_id, score, rank): a step for each pick."""
    steps = [_knn("asked", "corpus", fetch, "near"), "cands AS (SELECT n.query_id, n.doc_id, n.score, n.rank AS place, c.embedding FROM near n JOIN corpus c USING (doc_id))"]
    steps.append("p1 AS (SELECT query_id, doc_id, score, embedding, 1 AS rank FROM cands WHERE place = 1)")
    for i in range(2, k + 1):
        steps.append(f"""s{i} AS (SELECT query_id, doc_id, score, place, round(score * 0.5e0 - 0.5e0 * worst, 6) AS w FROM (SELECT c.query_id, c.doc_id, c.score, c.place, max({_sim('c.embedding', 'p.embedding')}) AS worst
  FROM cands c JOIN p{i - 1} p USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} x WHERE x.query_id = c.query_id AND x.doc_id = c.doc_id) GROUP BY c.query_id, c.doc_id, c.score, c.place)),
p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT s.query_id, s.doc_id, s.score, c.embedding, {i} FROM (SELECT * FROM s{i} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, place) = 1) s JOIN corpus c USING (doc_id))""")
    return ",\n".join(steps)


def _metrics(ranking: str) -> str:
    return f"""SELECT query_id, CAST(coalesce(h, 0) AS DOUBLE) / coalesce(n, 1) AS precision_at_k, CAST(coalesce(h, 0) AS DOUBLE) / w AS recall_at_k, coalesce(1.0e0 / f, 0) AS reciprocal_rank, coalesce(h, 0) > 0 AS hit
FROM (SELECT a.query_id, (SELECT count(*) FROM corpus x WHERE x.label = a.label) AS w FROM asked a) LEFT JOIN
(SELECT r.query_id, count(*) AS n, count(*) FILTER (WHERE c.label = a.label) AS h, min(r.rank) FILTER (WHERE c.label = a.label) AS f FROM {ranking} r JOIN corpus c ON c.doc_id = r.doc_id JOIN asked a ON a.query_id = r.query_id GROUP BY r.query_id) USING (query_id)"""


def _all_modes() -> str:
    again, rerank = _rerank("fused20", "corpus").split(")\nSELECT", 1)
    rankings = {"vector": "(SELECT * FROM near WHERE rank <= 6)", "mmr": "p6", "hybrid": "(SELECT * FROM fused WHERE rank <= 6)", "hybrid_rerank": "reranked"}
    rows = " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM ({_metrics(r)})" for m, r in rankings.items())
    return f"""WITH corpus AS (SELECT d.doc_id, d.text, d.lang, e.embedding, e.label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id), asked AS (SELECT doc_id AS query_id, 0 AS variant, text, embedding, label FROM corpus),
{_mmr()}, {_bm25("asked", "corpus", 20)}, {_fused(None)}, fused20 AS (SELECT * FROM fused WHERE rank <= 20), {again}), reranked AS (SELECT{rerank}), rows_ AS ({rows})
SELECT mode, round_even(avg(precision_at_k), 4) AS precision_at_k, round_even(avg(recall_at_k), 4) AS recall_at_k, round_even(avg(reciprocal_rank), 4) AS mrr, round_even(avg(CASE WHEN hit THEN 1.0e0 ELSE 0.0e0 END), 4) AS hit_rate, count(*) AS n FROM rows_ GROUP BY mode"""


# -- telemetry

LOG = """log AS (SELECT ts, CAST(user_id AS VARCHAR) AS collection, event_type AS mode, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, event_type = 'error' AS failed FROM events)"""


def _summary(where: str = "true") -> str:
    return f"""WITH {LOG}
SELECT mode, count(*) AS total_queries, count(*) FILTER (WHERE failed) AS error_count,
 coalesce(round_even(CAST(count(*) FILTER (WHERE failed) AS DOUBLE) / nullif(count(*), 0), 4), 0) AS error_rate,
 coalesce(round_even(CAST(count(*) FILTER (WHERE NOT failed AND k % 5 > 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT failed), 0), 4), 0) AS hit_rate,
 coalesce(round_even(avg(value), 2), 0) AS avg_retrieval_latency_ms, coalesce(round_even(avg(2 * value) FILTER (WHERE NOT failed), 2), 0) AS avg_generation_latency_ms, coalesce(round_even(avg(3 * value), 2), 0) AS avg_total_latency_ms,
 coalesce(list_sort(list(3 * value))[CAST(least(floor(count(*) * 0.5e0), count(*) - 1) AS INT) + 1], 0) AS p50_total_latency_ms,
 coalesce(list_sort(list(3 * value))[CAST(least(floor(count(*) * 0.95e0), count(*) - 1) AS INT) + 1], 0) AS p95_total_latency_ms,
 coalesce(round_even(avg(k) FILTER (WHERE NOT failed), 2), 0) AS avg_prompt_tokens, coalesce(round_even(avg(1) FILTER (WHERE NOT failed), 2), 0) AS avg_completion_tokens
FROM log WHERE {where} GROUP BY GROUPING SETS ((), (mode))"""


DAILY = "daily AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, round(avg(value), 8) AS mean_value, count(*) AS n FROM events GROUP BY ALL)"
MARK = r"^\s*(?:\d+[.)]|[-*•])\s*(.+)$"


def _bare(x: str) -> str:
    strip = lambda y: f"regexp_replace({y}, '^\\s+|\\s+$', '', 'g')"
    return strip(f"regexp_replace({strip(x)}, '^\"+|\"+$', '', 'g')")


def _items(text: str, n: int) -> str:
    lines = f"list_filter(list_transform(regexp_split_to_array({text}, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
    item = _bare(f"CASE WHEN regexp_matches(x, '{MARK}') THEN regexp_extract(x, '{MARK}', 1) ELSE x END")
    return f"list_filter(list_transform({lines}, lambda x: {item}), lambda x: x <> '')[1:{n}]"


SQL: dict[str, str] = {
    "scan_filter_language_source": "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src1'",
    "distinct_sources": "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL",
    "distinct_languages": "SELECT DISTINCT lang FROM documents WHERE lang <> ''",
    "first_hash_per_source": "SELECT source AS path, arg_min(sha256(text), doc_id) AS stored FROM documents GROUP BY source",
    "collections_excluding_prefix": "SELECT source AS name, count(*) AS chunk_count FROM documents WHERE NOT starts_with(source, 'src1') GROUP BY source",
    "delete_sources": "SELECT doc_id, source FROM documents WHERE source IS NULL OR source NOT IN ('src1', 'src2', 'src3')",
    "parse_props_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)",
    "file_summary": "SELECT count(*) AS files, round_even(sum(round_even(strlen(text) / 1024.0e0, 2)), 2) AS total_kb FROM documents",
    "files_by_extension": f"SELECT coalesce(nullif({EXT}, ''), 'unknown') AS extension, count(*) AS files FROM ({PATHS}) GROUP BY 1",
    "ingestion_stats": "SELECT count(*) AS chunks, count(DISTINCT source) AS sources FROM documents",
    "chunks_by_language": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "group_by_language": f"SELECT *, count(*) OVER (PARTITION BY language) AS n, row_number() OVER (PARTITION BY language ORDER BY path) AS place FROM (SELECT {LANGUAGE} AS language, path FROM ({PATHS}))",
    "filter_options": "SELECT 0 AS position, 'All languages' AS option UNION ALL SELECT DISTINCT 1, lang FROM documents WHERE lang <> ''",
    "running_size_cap": "SELECT source, doc_id, CAST(sum(n_chars) OVER w AS BIGINT) AS running, sum(n_chars) OVER w > 100000 AS over_cap FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)",
    "batch_assign": "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS batch FROM documents",
    "readable_pages": f"SELECT page_id, {EXT} NOT IN {_in(config.SKIPPED_EXTENSIONS)} AND {EXT} IN {_in(config.SUPPORTED_EXTENSIONS)} AND NOT list_has_any(string_split(path, '/'), [{_in(config.SKIPPED_DIRS)[1:-1]}]) AS readable FROM ({PATHS})",
    "page_context": f"""SELECT page_id, {EXT} AS extension, {LANGUAGE} AS language, {_map(config.FENCES, LANGUAGE, "''")} AS fence,
 {EXT} NOT IN {_in(config.CONFIG_EXTENSIONS)} AND {EXT} NOT IN {_in(config.MARKUP_EXTENSIONS)} AND {LANGUAGE} <> 'Unknown' AS is_code, {EXT} IN {_in(config.CONFIG_EXTENSIONS)} AS is_config, {EXT} IN {_in(config.MARKUP_EXTENSIONS)} AS is_markup FROM ({PATHS})""",
    "page_role": f"SELECT page_id, {_role('path')} AS role FROM ({PATHS})",
    "page_icon": f"""SELECT DISTINCT path, {_map(config.ICONS, LANGUAGE, f"'{config.DEFAULT_ICON}'")} AS icon FROM ({PATHS})""",
    "page_tree": f"SELECT DISTINCT CAST(i AS INT) AS depth, array_to_string(parts[1:i], '/') AS prefix, parts[i] AS name, i = len(parts) AS is_file FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT string_split(path, '/') AS parts FROM ({PATHS})))",
    "sanitize_names": """SELECT p_partkey, lower(CASE WHEN length(c) < 3 THEN c || '-qa' ELSE c END) AS name FROM (SELECT p_partkey, substr(trim(regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9-]', '-', 'g'), '-+', '-', 'g'), '-'), 1, 63) AS c FROM part)""",
    "normalize_paths": "SELECT p_partkey, p_brand || '/' || p_name AS path FROM part",
    "chunk_header": f"SELECT doc_id, {HEADER} || text AS page_content FROM documents",
    "tokenize_counts": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "document_frequency": f"SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY token",
    "token_estimate": "SELECT doc_id, CAST(greatest(1, round_even(length(text) / 4.0e0, 0)) AS INT) AS tokens FROM documents",
    "content_hashes": "SELECT doc_id, sha256(text) AS hash, regexp_matches(text, '\\S') AS not_blank FROM documents",
    "keyword_coverage": f"SELECT doc_id, {COVERAGE} AS keyword_coverage, {COVERAGE} >= 0.5e0 AS keyword_hit FROM documents",
    "answer_metrics": f"SELECT round_even(avg({COVERAGE}), 4) AS keyword_coverage, round_even(avg(CASE WHEN {COVERAGE} >= 0.5e0 THEN 1.0e0 ELSE 0.0e0 END), 4) AS keyword_hit_rate, count(*) AS n FROM documents",
    "judge_parse": f"WITH {JUDGED} SELECT * FROM judged",
    "judge_aggregate": f"WITH {JUDGED} SELECT round_even(avg(score), 4) AS score, " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in ("correct", "partial", "incorrect", "error")) + ", count(*) AS n FROM judged",
    "sync_diff": f"WITH {SNAPSHOTS} SELECT path, status FROM found",
    "sync_stats": f"WITH {SNAPSHOTS} SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS files_{s}" for s in ("new", "updated", "unchanged", "deleted")) + " FROM found",
    "replace_changed": f"WITH {SNAPSHOTS} SELECT path AS source, 0 AS chunk_index, coalesce(hash, stored) AS content_hash FROM found WHERE status <> 'deleted'",
    "dedup_embed_share": "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS embedded_as FROM documents",
    "duplicate_chunks": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "knn_topk": f"WITH {VECTORS}, {_knn('asked', 'corpus', 20)} SELECT query_id, doc_id AS vec_id, score, CAST(rank AS INT) AS rank FROM near",
    "knn_filtered": f"WITH {VECTORS}, {_knn('asked', '(SELECT * FROM corpus WHERE label = 3)', 6)} SELECT query_id, doc_id AS vec_id, score, CAST(rank AS INT) AS rank FROM near",
    "mmr_select": f"WITH {VECTORS}, {_mmr()} SELECT query_id, doc_id AS vec_id, score, CAST(rank AS INT) AS rank FROM p6",
    "bm25_topk": f"WITH {WORDS_OF_ALL} {OUT} words",
    "bm25_short": f"WITH asked AS (SELECT query_id, variant, array_to_string({_tokens('text')}[1:4], ' ') AS text FROM ({TEXTS_ASKED})), {_bm25('asked', 'documents', 10)} {OUT} words",
    "bm25_filtered": f"WITH asked AS ({TEXTS_ASKED}), {_bm25('asked', '''(SELECT * FROM documents WHERE lang = 'en')''', 6)} {OUT} words",
    "rrf_fuse": f"WITH {CORPUS}, {WORDS_OF_DOCUMENTS}, {_knn('asked', 'corpus', 20)}, {_fused(None)} {OUT} fused",
    "hybrid_topk": f"WITH {CORPUS}, asked AS ({_asked()}), {_bm25('asked', 'corpus', 20)}, {_knn('asked', 'corpus', 20)}, {_fused(6)} {OUT} fused",
    "hybrid_filtered": f"WITH {CORPUS}, english AS (SELECT * FROM corpus WHERE lang = 'en'), asked AS ({_asked()}), {_bm25('asked', 'english', 20)}, {_knn('asked', 'english', 20)}, {_fused(6)} {OUT} fused",
    "hybrid_multi_query": f"WITH {CORPUS}, asked AS ({_asked()} UNION ALL {_asked(1, 1)}), {_bm25('asked', 'corpus', 20)}, {_knn('asked', 'corpus', 20)}, {_fused(6)} {OUT} fused",
    "lexical_rerank": f"WITH {WORDS_OF_DOCUMENTS}, {_rerank('words', 'documents')}",
    "hybrid_rerank_topk": f"WITH {CORPUS}, asked AS ({_asked()}), {_bm25('asked', 'corpus', 20)}, {_knn('asked', 'corpus', 20)}, {_fused(20)}, {_rerank('fused', 'corpus')}",
    "assemble_context": f"WITH {WORDS_OF_ALL} SELECT query_id, string_agg(d.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM words JOIN documents d USING (doc_id) WHERE rank <= 6 GROUP BY query_id",
    "source_summary": f"""WITH {WORDS_OF_ALL} SELECT query_id, CAST(rank AS INT) AS rank, d.source, d.lang AS language, 0 AS chunk_index, 1 AS total_chunks, '' AS symbol_name, '' AS symbol_type, '' AS parent_symbol
FROM words JOIN documents d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, d.source ORDER BY rank) = 1""",
    "eval_per_query": f"WITH {VECTORS}, {_knn('asked', 'corpus', 6)} {_metrics('near')}",
    "eval_by_mode": f"WITH {VECTORS}, {_mmr()}, v AS ({_metrics('(SELECT * FROM near WHERE rank <= 6)')}), m AS ({_metrics('p6')}), both_ AS (SELECT 'vector' AS mode, * FROM v UNION ALL SELECT 'mmr', * FROM m) "
    "SELECT mode, round_even(avg(precision_at_k), 4) AS precision_at_k, round_even(avg(recall_at_k), 4) AS recall_at_k, round_even(avg(reciprocal_rank), 4) AS mrr, round_even(avg(CASE WHEN hit THEN 1.0e0 ELSE 0.0e0 END), 4) AS hit_rate, count(*) AS n FROM both_ GROUP BY mode",
    "eval_all_modes": _all_modes(),
    "archive_files": """SELECT source || '/' || doc_id || extension AS path, extension, round_even(strlen(text) / 1024.0e0, 2) AS size_kb, sha256(text) AS hash
FROM (SELECT doc_id, coalesce(source, 'none') AS source, CASE WHEN lang = 'de' THEN '.md' ELSE '.txt' END AS extension, coalesce(text, '') AS text FROM documents WHERE lang IS DISTINCT FROM 'fr') WHERE source <> 'src5' AND regexp_matches(text, '\\S')""",
    "previous_run": f"WITH {DAILY} SELECT *, lag(mean_value) OVER w AS previous_mean_value, lag(n) OVER w AS previous_n FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day)",
    "run_diff": f"""WITH {DAILY}, long AS (SELECT day, event_type AS section, 'mean_value' AS metric, mean_value AS value FROM daily UNION ALL SELECT day, event_type, 'n', CAST(n AS DOUBLE) FROM daily)
SELECT section, metric, c.value AS "current", p.value AS previous, round_even(c.value - p.value, 4) AS delta FROM (SELECT * FROM long WHERE day = (SELECT max(day) FROM daily)) c JOIN (SELECT * FROM long WHERE day = (SELECT min(day) FROM daily)) p USING (section, metric)""",
    "metrics_overall_and_by_mode": _summary(),
    "metrics_since": _summary("ts >= TIMESTAMP '2024-01-15 00:00:00'"),
    "metrics_by_collection": _summary("collection = '7'"),
    "nearest_rank_percentiles": "SELECT event_type, " + ", ".join(f"list_sort(list(value))[CAST(least(floor(count(*) * {p}e0), count(*) - 1) AS INT) + 1] AS {n}" for n, p in (("p50", "0.5"), ("p95", "0.95"), ("p0", "0.0"))) + " FROM events GROUP BY event_type",
    "recent_turns": """WITH last_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
lines AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END AS line, regexp_matches(text, '\\S') AS has_text FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM last_ WHERE r <= 6))
SELECT conv_id, coalesce(string_agg(line, chr(10) ORDER BY turn) FILTER (WHERE has_text), '') AS history FROM lines GROUP BY conv_id""",
    "parse_numbered_list": f"SELECT conv_id, turn, CAST(i - 1 AS INT) AS pos, items[i] AS item FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM (SELECT conv_id, turn, {_items('text', 3)} AS items FROM conversations))",
    "expand_dedup": f"""WITH rows_ AS (SELECT conv_id || '/' || turn AS query_id, role AS question, {_items("'1. ' || text || chr(10) || '2) ' || text || chr(10) || '- ' || upper(role) || chr(10) || '- note' || chr(10) || '* NOTE'", 50)} AS items FROM conversations),
flat AS (SELECT query_id, question, items[i] AS phrasing, i FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM rows_)),
firsts AS (SELECT * FROM flat WHERE lower(phrasing) <> lower(question) QUALIFY row_number() OVER (PARTITION BY query_id, lower(phrasing) ORDER BY i) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) AS INT) AS variant, phrasing FROM firsts""",
}
