"""Operators on text corpora: deduplication, filtering, scoring, tokenising and archive files."""
