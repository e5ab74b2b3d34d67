"""Structured Streaming forms of the link measures."""
