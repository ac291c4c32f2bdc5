"""Structured Streaming callers of the batch operators."""
