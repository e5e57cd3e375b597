"""Structured Streaming forms of ingest, rollups and per-key state."""
