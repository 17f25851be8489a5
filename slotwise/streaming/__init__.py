"""Structured Streaming ingestion of live snapshots."""
