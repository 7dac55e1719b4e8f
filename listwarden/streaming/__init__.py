"""Incremental ingest and scoring with Structured Streaming."""
