"""Operators of a training-data pipeline: duplicates, contamination, quality, mixing, archives."""
