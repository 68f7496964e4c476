"""Structured Streaming forms of key templating and field profiling (O-47, O-48)."""
