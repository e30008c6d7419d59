"""Queries over the driver's tables."""

from . import fact_queries, graph_queries, record_queries, search_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
