"""Structured Streaming over the query log (an extension; the batch queries don't need it)."""
