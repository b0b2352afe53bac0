"""Names of the library's queries, and their DuckDB SQL."""

from __future__ import annotations

from . import describe, feeds, library, posts, reports, scans, similarity, state, streams, tagging, text  # noqa: F401
from .query import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
