"""Queries: operators bound to tables, and the same in SQL."""
