"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from newsloom.operators import accounts, alerts, article_run, articles, changes, classify, curation, enrichment, events, feed_files, feeds, maintenance, networks, related, scalar_queries, search, search_index, security, trees, upkeep
from newsloom.sources import archives, ordered_files
from newsloom.streaming import queries as streaming

_MODULES = (related, feeds, feed_files, events, alerts, maintenance, classify, search, search_index, security, networks, enrichment, curation, accounts, articles, article_run, changes, trees, upkeep, ordered_files, archives, scalar_queries, streaming)
QUERIES: dict = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
