"""Readers and writers for the lake, the topics and the sample readings."""
