"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import browse_queries, extract_queries, index_queries, ingest_queries, page_queries, record_queries, search_queries
from .search_queries import flagship

QUERIES = search_queries.QUERIES | index_queries.QUERIES | ingest_queries.QUERIES | extract_queries.QUERIES | browse_queries.QUERIES | page_queries.QUERIES | record_queries.QUERIES
ORACLES = search_queries.ORACLES | index_queries.ORACLES | ingest_queries.ORACLES | extract_queries.ORACLES | browse_queries.ORACLES | page_queries.ORACLES | record_queries.ORACLES

__all__ = ["ORACLES", "QUERIES", "flagship"]
