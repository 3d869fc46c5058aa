"""Structured Streaming over image files."""
