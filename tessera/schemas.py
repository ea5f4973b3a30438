"""Schemas; nothing is inferred from data."""

from __future__ import annotations

FILES = "path string, content string, extension string, size_kb double"
CHUNKS = (
    "source string, language string, fence string, is_code boolean, is_config boolean, is_markup boolean, role string, chunk_index int, total_chunks int, "
    "size_kb double, content_hash string, chunk_content_hash string, chunk_method string, symbol_name string, symbol_type string, parent_symbol string, page_content string"
)
QUERY_LOG = (
    "timestamp string, collection string, retrieval_mode string, hit_count bigint, retrieval_latency_ms double, generation_latency_ms double, total_latency_ms double, "
    "prompt_tokens_estimate bigint, completion_tokens_estimate bigint, query_rewritten boolean, query_expansion_count bigint, error boolean"
)
EVAL_ITEM = "question string, expected_sources array<string>, expected_keywords array<string>"
EVAL_RUN = "timestamp string, k bigint, n bigint, config map<string,string>, results map<string,map<string,map<string,double>>>"
