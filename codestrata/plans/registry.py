"""Queries of the core, by name, and their SQL."""

from __future__ import annotations

from codestrata.plans import context_queries, governance_queries, graph_queries, history_queries, impact_queries, nested_queries, resolution_queries, retrieval_queries, source_queries, store_queries, stream_queries

MODULES = (nested_queries, graph_queries, impact_queries, resolution_queries, history_queries, governance_queries, retrieval_queries, context_queries, store_queries, source_queries, stream_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
