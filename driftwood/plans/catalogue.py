"""All queries of the journal and tree operators."""

from __future__ import annotations

from . import binary_queries, cas_queries, journal_queries, replica_queries, surface_queries, tree_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
