"""Registry of the subpackage's queries and their SQL."""

from __future__ import annotations

from gleanery.llm import (
    abuse_queries,
    duplicate_queries,
    leak_queries,
    page_queries,
    scan_queries,
    token_queries,
    turn_queries,
    vector_queries,
)

MODULES = [
    page_queries, scan_queries, turn_queries, vector_queries, duplicate_queries, token_queries, leak_queries, abuse_queries,
]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
