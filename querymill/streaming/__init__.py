"""Structured Streaming: resumable ingest, deduplication and windowed counts."""
