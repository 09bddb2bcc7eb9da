"""All queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from codestrata.llm import doc_queries, leak_queries, name_queries, packing_queries, quality_queries, record_queries

MODULES = (record_queries, doc_queries, name_queries, packing_queries, leak_queries, quality_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
