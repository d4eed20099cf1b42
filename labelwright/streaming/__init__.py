"""Structured Streaming forms of the track operators."""
