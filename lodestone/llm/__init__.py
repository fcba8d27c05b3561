"""Operators for preparing training data: token counts, near-duplicates, scoring, filtering and packing."""
