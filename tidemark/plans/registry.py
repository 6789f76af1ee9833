"""All queries, of every module of this folder."""

from tidemark.plans import archive, extraction, gates, names, reviews, roadmap, selection, trends  # noqa: F401
from tidemark.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
