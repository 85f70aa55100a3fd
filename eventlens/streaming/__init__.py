"""Structured Streaming: incremental landing and windowed counts."""
