"""Operators of a training-data pipeline: deduplication, scoring, search, mixing and packing of text."""
