"""Operators of a training-data pipeline: cleaning, scoring, search, deduplication, mixing, tokens."""
