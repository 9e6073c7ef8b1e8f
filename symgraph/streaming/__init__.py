"""Structured Streaming over the store."""
