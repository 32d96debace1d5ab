"""All queries of the core and the SQL they are held against."""

from __future__ import annotations

from siltstone.plans import core_problems, flow_queries, index_queries, retrieval_queries, search_queries

_PARTS = (core_problems, search_queries, index_queries, retrieval_queries, flow_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
FLAGSHIP = "term_search"
