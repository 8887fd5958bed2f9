"""Queries by name, and the SQL that must return the same rows. Each module below registers its own."""

from __future__ import annotations

from . import context_queries, dialogue_queries, log_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (context_queries, dialogue_queries, log_queries, stream_queries):
    QUERIES |= _module.REGISTERED.queries
    ORACLES |= _module.REGISTERED.oracles

#: The query that entry() runs.
FLAGSHIP = "accuracy_by_bin"
