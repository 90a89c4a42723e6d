"""Structured Streaming forms of ingest, registry upkeep and cache lookup."""
