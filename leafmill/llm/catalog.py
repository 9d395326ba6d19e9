"""All text queries and their SQL."""

from leafmill.llm import lookalike_queries, mixing_queries, repeat_queries, scan_queries, sentence_queries, token_queries, truncation_queries

_MODULES = [repeat_queries, truncation_queries, lookalike_queries, scan_queries, token_queries, mixing_queries, sentence_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
