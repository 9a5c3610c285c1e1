"""Structured Streaming: the ingest queue."""
