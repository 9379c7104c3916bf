"""Operators of a training-data pipeline: tokens, dedup, quality, safety, archives."""
