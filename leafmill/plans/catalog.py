"""All core queries and their SQL."""

from leafmill.plans import flatten_queries, metric_queries, retrieval_queries, rollup_queries

_MODULES = [flatten_queries, metric_queries, rollup_queries, retrieval_queries]
FLAGSHIP = "bm25_topk"
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
