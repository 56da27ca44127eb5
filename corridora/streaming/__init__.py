"""Structured Streaming forms of the report log."""
