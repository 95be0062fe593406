"""Structured Streaming queries over the same operators."""
