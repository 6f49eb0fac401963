"""Incremental consolidation over Structured Streaming."""
