"""Structured Streaming forms of ingest, daily metrics, status and quota."""
