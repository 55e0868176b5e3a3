"""Structured Streaming forms of the detection cycle."""
