"""Structured Streaming forms of sessions, incremental indexing and windowed counts."""
