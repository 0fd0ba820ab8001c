"""Streaming forms: statistics of files that keep arriving."""
