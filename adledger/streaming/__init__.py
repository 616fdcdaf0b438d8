"""Structured Streaming forms of ingest and availability tracking."""
