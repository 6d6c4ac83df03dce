"""Operators that prepare training data: deduplication, scoring, mixing, packing, archives, search."""
