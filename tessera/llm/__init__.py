"""Operators for preparing training data: scoring, filtering, deduplicating, mixing, tokenising and searching."""
