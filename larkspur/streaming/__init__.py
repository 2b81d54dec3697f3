"""Structured Streaming versions of batch operators."""
