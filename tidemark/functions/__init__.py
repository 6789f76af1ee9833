"""Column functions: numbers, text, addresses and time."""

from tidemark.functions.columns import capped, clamp, clamp01, day_number, decay, half_even, half_up, iso_date, jaccard, lag_hours, local_day, norm_title, page_heading, page_title, page_titles, title_tokens, tokens, word_overlap
from tidemark.functions.urls import host, ingest_url, suffixes, topic_url, valid_url

__all__ = [
    "capped", "clamp", "clamp01", "day_number", "decay", "half_even", "half_up", "host", "ingest_url", "iso_date", "jaccard", "lag_hours",
    "local_day", "norm_title", "page_heading", "page_title", "page_titles", "suffixes", "title_tokens", "tokens", "topic_url", "valid_url", "word_overlap",
]
