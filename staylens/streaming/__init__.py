"""Structured Streaming jobs: parse, resolve, score, aggregate, store."""
