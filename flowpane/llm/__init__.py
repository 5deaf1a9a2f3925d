"""Operators for large training corpora: tokenising, filtering, deduplication, search, mixing."""
