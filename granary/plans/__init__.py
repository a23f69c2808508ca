"""Registered queries, each with the SQL that states its result."""

from __future__ import annotations

from . import aggregates, changes, joins, scalars, scans, shards
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "changes", "joins", "scalars", "scans", "shards"]
