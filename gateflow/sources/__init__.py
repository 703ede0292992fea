"""Readers and parsers of what cameras, pipelines and agents produce, and writers."""
