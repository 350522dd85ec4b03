"""Structured Streaming forms of ingest and running totals."""
