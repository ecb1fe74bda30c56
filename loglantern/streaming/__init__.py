"""Structured Streaming jobs: ingest, views, enrichment and live trends."""
