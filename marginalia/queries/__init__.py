"""Queries over the tables, one for each operator, with their SQL."""

from marginalia.queries import documents, files, retrieval, store, texts  # noqa: F401
from marginalia.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
