"""Operators for large text corpora: search, deduplication, scoring, filtering and packaging."""
