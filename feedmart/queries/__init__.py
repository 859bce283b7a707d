"""Queries of the operators over the given tables, with their SQL."""

from . import feeds, lookups, quality, reach, refine, search, wishes
from .common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "feeds", "lookups", "quality", "reach", "refine", "search", "wishes"]
