"""Structured Streaming forms of classify and find similar."""
