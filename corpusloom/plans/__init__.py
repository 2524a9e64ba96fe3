"""Queries of the library over the driver's tables, each with its SQL where SQL can express it."""

from . import graph_queries, index_queries, operator_queries, source_queries, taxonomy_queries, text_queries  # noqa: F401  (each enters its queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
