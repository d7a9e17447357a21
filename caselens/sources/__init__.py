"""Readers of delimited evidence files, and a generator of some."""
