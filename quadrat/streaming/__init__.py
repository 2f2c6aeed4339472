"""Incremental ingest and event-time windows."""
