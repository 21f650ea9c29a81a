"""Structured Streaming wrappers of ingestion and metrics."""
