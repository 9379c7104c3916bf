"""Structured Streaming jobs over the same column functions."""
