"""Structured Streaming forms of the ingest, dedup, bucket and interval operators."""
