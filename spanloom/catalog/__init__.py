"""Queries over the driver's tables, each with the SQL that DuckDB runs on the same files."""

from spanloom.catalog import causes, changes, derived, detectors, outputs, relational, sources  # noqa: F401
from spanloom.catalog.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
