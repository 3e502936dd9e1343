"""Structured Streaming forms of the lookups and of the request-rate check."""
