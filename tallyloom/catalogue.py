"""Registered queries of the document engine and SQL that gives the same rows."""

from tallyloom.plans import changes, documents, ingest, relational, surface  # noqa: F401  they register themselves
from tallyloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
