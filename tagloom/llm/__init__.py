"""Operators of a training-data pipeline: deduplication, quality, mixing,
scoring, formatting, packing and archive audits."""
