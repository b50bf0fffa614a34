"""Operators of a training-data pipeline: formatting, scoring, extraction, deduplication, filtering and packing."""
